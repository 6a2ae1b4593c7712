"""Scalar text functions as columns: counting, masking, names, keys, dates, sizes.

Patterns are Java's; `(?U)` makes \\w and \\s follow Unicode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _c(x: C) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- counting -------------------------------------------------------------------------------------------------------


def spoken_words(text: C) -> Column:
    """Tokens between white space that hold a letter or digit."""
    return F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"(?U)\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def count_words(text: C) -> Column:
    """E27."""
    return F.size(spoken_words(text))


def distinct_ratio(words: Column) -> Column:
    """C20: distinct words over words, edge punctuation and case aside; 1 if there are none."""
    clean = F.transform(words, lambda x: F.lower(F.trim(x, F.lit(""".,;:!?"'()[]"""))))
    # An array of one binds the words to a name, so that they are made once and not once a use.
    return F.get(F.transform(F.array(clean), lambda w: F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(F.lit(1.0))), F.lit(0))


def distinct_word_ratio(text: C) -> Column:
    return distinct_ratio(spoken_words(text))


def tokens(text: C) -> Column:
    """I3."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit("[0-9a-zà-ɏ]+"), F.lit(0))


def token_coverage(needle: Column, window: Column) -> Column:
    """I4: share of the needle's tokens, repeats included, that the window has."""
    return F.when(F.size(needle) == 0, F.lit(0.0)).otherwise(F.size(F.filter(needle, lambda x: F.array_contains(window, x))) / F.size(needle))


def excerpt(text: C, limit: int = 160) -> Column:
    """One line, addresses masked, an ellipsis past the limit."""
    flat = F.trim(F.regexp_replace(strip_emails(text), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def light_normalise(text: C) -> Column:
    """Quote and dash shapes unified, white space collapsed, case kept."""
    return F.trim(F.regexp_replace(F.translate(_c(text), "‘’“”–—", "''\"\"--"), r"(?U)\s+", " "))


def loose(text: C) -> Column:
    """Lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^\p{L}\p{N}\s]", " "), r"(?U)\s+", " "))


# --- masking --------------------------------------------------------------------------------------------------------

#: The signs that stand for @.
AT = r"(?:[@＠﹫]|%40|&#0*64;|&#[xX]0*40;|&commat;)"
#: Letters of any script count, in names and hosts; brackets may stand about the sign.  (RE2 reads these patterns too.)
_NAME, _OPEN, _CLOSE = r"[\p{L}\p{M}\p{N}_.%+\-]", r"[<\[({]", r"[>\])}]"
EMAIL = rf"(?i){_NAME}+\s*{_OPEN}?\s*{AT}\s*{_CLOSE}?\s*[\p{{L}}\p{{M}}\p{{N}}_.\-]+\.[\p{{L}}\p{{M}}]{{2,}}"
#: An address said aloud: name, "at", labels and "dot"s.  A dot that is said may have spaces about it, a full stop may not.
_LABEL = r"[\p{L}\p{M}\p{N}\-]{2,}"
_SAID_AT = rf"(?:{_OPEN}\s*at\s*{_CLOSE}|\bat\b|{AT})"
_SAID_DOT = rf"(?:\s*{_OPEN}?\s*\bdot\b\s*{_CLOSE}?\s*|\.)"
DICTATED = rf"(?i)(?<!{_NAME}){_NAME}{{2,}}[\s,;:]*{_SAID_AT}\s*(?:{_LABEL}{_SAID_DOT})+[\p{{L}}\p{{M}}]{{2,}}\b"
#: Fixed value.
REMOVED = "[address removed]"
OWNER_REMOVED = "/personal/[owner removed]/"  # fixed value


def contains_email(text: C) -> Column:
    """I12."""
    return F.coalesce(_c(text).rlike(AT) & _c(text).rlike(EMAIL), F.lit(False))


def strip_emails(text: C, mark: str = REMOVED) -> Column:
    """I10, I73.  Texts without any sign for @, nearly all, are not searched further."""
    t = F.coalesce(_c(text), F.lit(""))
    return F.when(t.rlike(AT), F.regexp_replace(t, EMAIL, mark)).otherwise(t)


def contains_dictated(text: C) -> Column:
    """I13."""
    return F.coalesce(_c(text).rlike(DICTATED), F.lit(False))


def strip_dictated(text: C, mark: str = REMOVED) -> Column:
    """I11."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), DICTATED, mark)


def strip_owner_paths(text: C) -> Column:
    """I14, I76."""
    return F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?i)/personal/[^/\s]+/", OWNER_REMOVED)


def spoken_at(text: C) -> Column:
    """Every spelling of at and dot as the signs, white space collapsed."""
    t = F.regexp_replace(_c(text), r"(?U)\s+", " ")
    t = F.regexp_replace(t, rf"(?i)\s*(?:{_OPEN}?\s*{AT}\s*{_CLOSE}?|{_OPEN}\s*at\s*{_CLOSE})\s*", "@")
    return F.regexp_replace(t, rf"(?i){_SAID_DOT}", ".")


def scrub(text: C, secrets: Sequence[str]) -> Column:
    """Each secret replaced, the longest first."""
    out = _c(text)
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        out = F.replace(out, F.lit(s), F.lit("***"))
    return out


def mask_tail(value: C) -> Column:
    """Eight bullets and the last four characters, if there are more than four."""
    v = _c(value)
    return F.when(F.length(v) <= 4, F.repeat(F.lit("•"), 8)).otherwise(F.concat(F.repeat(F.lit("•"), 8), F.right(v, F.lit(4))))


def html_escape(text: C) -> Column:
    """I85."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def restore(text: Column, released: Column) -> Column:
    """Markers [held REF] replaced by the words released for them.  released: map of ref to words."""
    return F.aggregate(F.map_entries(released), text, lambda acc, e: F.replace(acc, F.concat(F.lit("[held "), e["key"], F.lit("]")), e["value"]))


def refs_in(text: C) -> Column:
    """I40."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"\[held ([0-9A-F]{6})\]"), F.lit(1)))


# --- names and keys -------------------------------------------------------------------------------------------------


def content_key(*parts: C, length: int = 16) -> Column:
    """A key from contents."""
    return F.substring(F.sha2(F.concat_ws("␟", *[_c(p).cast("string") for p in parts]), 256), 1, length)


def id_tag(item_id: C) -> Column:
    """I26."""
    return F.substring(F.sha2(_c(item_id).cast("string"), 256), 1, 8)


def stem(name: C) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(name), r"\.[^.]*$", ""), r"\s*\(\d{1,3}\)$", "")


def parsed_name(name: C) -> Column:
    """Struct of form, party, stamp, copy marker and whether the stamp is the recorder's default.

    Digits that are no real moment give no stamp; a stamp is read at the end of the stem only."""
    s = stem(name)
    tail = F.regexp_extract(s, r"^(.*)_(\d{6})_(\d{6})$", 1)
    voice = s.rlike(r"^Voice \d{6}_\d{6}$")
    digits = F.when(voice, F.regexp_replace(F.regexp_extract(s, r"(\d{6}_\d{6})$", 1), "_", "")).otherwise(F.concat(F.regexp_extract(s, r"_(\d{6})_(\d{6})$", 1), F.regexp_extract(s, r"_(\d{6})_(\d{6})$", 2)))
    at = F.try_to_timestamp(F.when(F.length(digits) == 12, digits), F.lit("yyMMddHHmmss"))
    called = r"(?i)^call(?:[\s_]+(recording))?(?:[\s_]+(.+))?$"
    form = F.when((tail != "") & tail.rlike(called), F.when(F.regexp_extract(tail, called, 1) != "", "call-recording").otherwise("call")).otherwise("free-text")
    party = F.when((tail != "") & tail.rlike(called), F.nullif(F.trim(F.regexp_extract(tail, called, 2)), F.lit("")))
    copy = F.nullif(F.regexp_extract(F.regexp_replace(_c(name), r"\.[^.]*$", ""), r"\((\d{1,3})\)$", 1), F.lit("")).cast("int")
    return F.struct(form.alias("form"), party.alias("party"), at.alias("at"), copy.alias("copy"), (voice & at.isNotNull()).alias("recovered"))


def resolved_moment(at: Column, recovered: Column, created: Column) -> Column:
    """The name's moment, unless it was only inferred and lies over a day after the file's creation."""
    return F.when(at.isNull(), created).when(recovered & (at > created + F.expr("interval 24 hours")), created).otherwise(at)


def safe_stem(text: C, most: int = 120) -> Column:
    """A file name's stem without addresses or forbidden signs; cut at a space past the middle."""
    t = F.regexp_replace(strip_emails(text, "address-removed"), r'[\\/:*?"<>|#%@＠﹫\x00-\x1f]+', "-")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), r"^[-. ]+|[-. ]+$", "")
    cut = F.substring(t, 1, most)
    at_space = F.regexp_extract(cut, r"^(.*) ", 1)
    short = F.when(F.length(t) <= most, t).when(F.length(at_space) > most // 2, at_space).otherwise(cut)
    return F.when(short == "", "recording").otherwise(F.regexp_replace(short, r"[-. ]+$", ""))


def output_stem(at: Column, name_stem: Column, copy: Column, item_id: C) -> Column:
    """I23, I25."""
    return F.concat(F.date_format(at, "yyyyMMdd-HHmmss"), F.lit("-"), name_stem, F.coalesce(F.concat(F.lit("-copy"), copy.cast("string")), F.lit("")), F.lit("-"), id_tag(item_id))


def is_slug(name: C) -> Column:
    """I92, C22."""
    return _c(name).rlike(r"^[a-z0-9][a-z0-9-]*$")


def slug(label: C) -> Column:
    """I93, I91."""
    return F.regexp_replace(F.lower(F.regexp_replace(_c(label), r"[^\p{L}\p{N}]+", "-")), "^-+|-+$", "")


def display_name(address: C) -> Column:
    """I88."""
    a = _c(address)
    return F.when(F.contains(a, F.lit("@")), F.trim(F.translate(F.split_part(a, F.lit("@"), F.lit(1)), "._", "  "))).otherwise(a)


def luhn(digits: C) -> Column:
    """I49."""
    return F.coalesce(F.call_function("luhn_check", _c(digits)), F.lit(False))


def is_identity_number(digits: C) -> Column:
    """13 digits, a month and day, a citizenship digit, a checksum."""
    d = _c(digits)
    month, day = F.substring(d, 3, 2).cast("int"), F.substring(d, 5, 2).cast("int")
    return F.coalesce(F.when(d.rlike(r"^\d{13}$"), month.between(1, 12) & day.between(1, 31) & F.substring(d, 11, 1).isin("0", "1") & luhn(d)), F.lit(False))


def host_of(url: C) -> Column:
    """Host with port and user part, as it stands."""
    return F.regexp_extract(_c(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def redact_url(url: C) -> Column:
    """I61."""
    u = _c(url)
    return F.concat(F.regexp_replace(u, r"[?#].*$", ""), F.when(F.contains(u, F.lit("?")), "?<redacted>").otherwise(""))


def fenced(text: C) -> Column:
    """Text that can't close the fence around it."""
    return F.concat(F.lit("<transcript>\n"), F.replace(F.replace(_c(text), F.lit("<"), F.lit("‹")), F.lit(">"), F.lit("›")), F.lit("\n</transcript>"))


def header_map(text: C) -> Column:
    """The six known header fields up to the first blank line, names in lower case, the last of each."""
    lines = F.split(F.split_part(_c(text), F.lit("\n\n"), F.lit(1)), "\n")
    known = F.filter(lines, lambda x: F.lower(x).rlike(r"^(from|to|cc|subject|date|sent):"))
    pairs = F.transform(known, lambda x: F.struct(F.lower(F.trim(F.split_part(x, F.lit(":"), F.lit(1)))).alias("key"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    # one entry a key whatever the session says of repeated keys
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["key"]), F.map_from_arrays(F.array(e["key"]), F.array(e["value"]))))


def contract_problems(text: C, subject: Column) -> Column:
    """What keeps a rendered text from being read downstream, as an array of rule names."""
    h, t = header_map(text), _c(text)
    rule = lambda name, bad: F.when(bad, F.lit(name))
    return F.array_compact(F.array(
        rule("no subject", F.element_at(h, "subject").isNull()), rule("subject differs", F.element_at(h, "subject") != subject), rule("no date", F.element_at(h, "date").isNull()),
        rule("date is not ISO", ~F.coalesce(F.element_at(h, "date").rlike(r"^\d{4}-\d{2}-\d{2}"), F.lit(True))), rule("no body", F.trim(F.coalesce(F.regexp_extract(t, r"(?s)^.*?\n\n(.*)$", 1), F.lit(""))) == ""),
        rule("holds an address", contains_email(t)),
    ))


# --- dates, sizes, numbers ------------------------------------------------------------------------------------------


def stamp(ts: C) -> Column:
    """I15."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_of(text: C) -> Column:
    """I16, I75."""
    return F.regexp_extract(_c(text), r"(\d{4}-\d{2}-\d{2})", 1)


def parse_stamp(text: C) -> Column:
    """Seconds since the epoch of an ISO moment, null if it is none."""
    return F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(_c(text), r"(\.\d{6})\d+", "$1")))


def days_between(first: C, second: C) -> Column:
    """I19."""
    return F.greatest(F.lit(0), F.datediff(F.substring(_c(second), 1, 10).cast("date"), F.substring(_c(first), 1, 10).cast("date")))


def clock(seconds: C) -> Column:
    """I78."""
    s = F.greatest(F.lit(0), F.floor(_c(seconds))).cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def human_duration(seconds: C) -> Column:
    """I67, I87."""
    s = F.floor(_c(seconds)).cast("long")
    many = lambda n, word: F.concat(n.cast("string"), F.lit(" " + word), F.when(n == 1, "").otherwise("s"))
    return F.when(s < 60, many(s, "second")).when(s < 3600, many(F.floor(s / 60), "minute")).when(s < 86400, many(F.floor(s / 3600), "hour")).otherwise(many(F.floor(s / 86400), "day"))


UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1000, "kib": 1 << 10, "m": 1 << 20, "mb": 1000**2, "mib": 1 << 20, "g": 1 << 30, "gb": 1000**3, "gib": 1 << 30, "t": 1 << 40, "tb": 1000**4, "tib": 1 << 40}


def parse_bytes(text: C) -> Column:
    """I65; null for what is no size."""
    t = F.lower(F.trim(_c(text)))
    unit = F.element_at(F.create_map(*[F.lit(x) for kv in UNITS.items() for x in kv]), F.regexp_extract(t, r"^[0-9.]+\s*([a-z]*)$", 1))
    return F.floor(F.try_to_number(F.regexp_extract(t, r"^([0-9]+)", 1), F.lit("999999999999999")).cast("double") * unit).cast("long")


def format_bytes(n: C) -> Column:
    """To a tenth; a tie goes to the even digit, as in C's printf (Java's would go up)."""
    v = _c(n).cast("double")

    def step(p: int, unit: str) -> Column:
        x = v / (1 << p)  # exact, and so is its part below one
        return F.concat(F.format_string("%.1f", x - x % 1 + F.rint(x % 1 * 10) / 10), F.lit(" " + unit))

    return F.when(v < 1 << 10, F.concat(v.cast("long").cast("string"), F.lit(" B"))).when(v < 1 << 20, step(10, "KiB")).when(v < 1 << 30, step(20, "MiB")).otherwise(step(30, "GiB"))


def confidence(x: C) -> Column:
    """I56."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(_c(x).cast("double"), F.lit(0.0)), F.lit(0.0))))


def backoff(attempt: C, base: float = 30, cap: float = 3600) -> Column:
    """The span of a back-off; a wait lies between its half and itself."""
    return F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), _c(attempt) - 1))


def jittered(attempt: C, base: float = 30, cap: float = 3600) -> Column:
    return backoff(attempt, base, cap) * (F.lit(0.5) + F.rand() / 2)


def retry_after(value: C, now: Column) -> Column:
    """Seconds to wait, from a number or an HTTP date."""
    v = _c(value)
    date = F.unix_timestamp(F.try_to_timestamp(F.regexp_replace(v, r"^\w+, ", ""), F.lit("dd MMM yyyy HH:mm:ss 'GMT'"))) - F.unix_timestamp(now)
    return F.greatest(F.lit(0.0), F.coalesce(v.try_cast("double"), date.cast("double")))


ISO3 = {"en": "eng", "de": "deu", "fr": "fra", "es": "spa", "af": "afr", "zu": "zul", "xh": "xho", "pt": "por", "nl": "nld"}


def language(locale: C) -> Column:
    """I59."""
    return F.nullif(F.lower(F.regexp_extract(_c(locale), r"^([A-Za-z]{2,3})(?:[-_].*)?$", 1)), F.lit(""))


def language3(locale: C) -> Column:
    """I60."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in ISO3.items() for x in kv]), language(locale))


def token_usage(usage: C) -> Column:
    """The four counters of a call from either provider's JSON; cached input is not counted twice."""
    u = _c(usage)
    get = lambda p: F.get_json_object(u, p).cast("long")
    cached = F.coalesce(get("$.cache_read_input_tokens"), get("$.prompt_tokens_details.cached_tokens"), F.lit(0))
    inp = F.coalesce(get("$.input_tokens"), F.greatest(F.lit(0), get("$.prompt_tokens") - cached), F.lit(0))
    return F.struct(inp.alias("input"), F.coalesce(get("$.output_tokens"), get("$.completion_tokens"), F.lit(0)).alias("output"), cached.alias("cache_read"), F.coalesce(get("$.cache_creation_input_tokens"), F.lit(0)).alias("cache_write"))


def merge_meta(old: C, new: C) -> Column:
    """JSON objects merged, the new value of a key wins."""
    as_map = lambda x: F.coalesce(F.from_json(_c(x), "map<string,string>"), F.create_map().cast("map<string,string>"))
    a, b = as_map(old), as_map(new)
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b)


REASONS = (("(?i)timed? ?out|timeout", "it took too long to answer"), ("(?i)\\b(401|403)\\b|unauthori[sz]ed|forbidden", "the key was refused"), ("(?i)\\b429\\b|rate limit", "too many requests"), ("(?i)\\b5\\d\\d\\b", "the other side failed"), ("(?i)truncat|incomplete", "the file is not whole"))


def plain_reason(error: C) -> Column:
    """An error in one sentence."""
    out = F.when(_c(error).isNull() | (_c(error) == ""), "no reason recorded")
    for pattern, said in REASONS:
        out = out.when(_c(error).rlike(pattern), said)
    return out.otherwise("something else went wrong")
