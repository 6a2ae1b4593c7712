"""Queries over texts: counting, masking, names, keys, entities, quotes, the gate."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import matching as M
from siltstone.functions import text as T
from siltstone.functions.text import EMAIL
from siltstone.operators import entities as E
from siltstone.operators import gate as G
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.sources.adapter import ITEMS, items

R = Registry()


def docs(spark, d):
    return table(spark, d, "documents")


@R("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) as words from documents")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", T.count_words("text").cast("long").alias("words"))


@R("""with w as (select doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')), lambda x: lower(regexp_replace(x, '^[.,;:!?"''()\\[\\]]+|[.,;:!?"''()\\[\\]]+$', '', 'g'))) as w from documents)
    select doc_id, case when len(w) > 0 then len(list_distinct(w)) / len(w) else 1.0 end as ratio from w""")
def distinct_word_ratio(spark, d):
    return docs(spark, d).select("doc_id", T.distinct_word_ratio("text").alias("ratio"))


@R(r"select doc_id, len(regexp_extract_all(lower(text), '[0-9a-zà-ɏ]+')) as tokens from documents")
def token_counts(spark, d):
    return docs(spark, d).select("doc_id", F.size(T.tokens("text")).cast("long").alias("tokens"))


@R(f"select doc_id, regexp_matches(text, '{EMAIL}') as flagged from documents")
def email_flag(spark, d):
    return docs(spark, d).select("doc_id", T.contains_email("text").alias("flagged"))


@R(f"select doc_id, md5(regexp_replace(text, '{EMAIL}', '[address removed]', 'g')) as digest from documents")
def emails_stripped(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.strip_emails("text")).alias("digest"))


@R("select doc_id, left(sha256(concat_ws('␟', doc_id, 0, n_chars, text)), 16) as key, upper(left(sha256(concat_ws('␟', doc_id, 0, n_chars, text)), 6)) as ref from documents")
def content_hash_key(spark, d):
    key = T.content_key("doc_id", F.lit(0), "n_chars", "text")
    return docs(spark, d).select("doc_id", key.alias("key"), F.upper(F.substring(key, 1, 6)).alias("ref"))


@R("select doc_id, md5(lower(text)) as digest from documents")
def unicode_lower_hash(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.lower("text")).alias("digest"))


@R("""select doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) as loose, left(md5(trim(regexp_replace(translate(text, '‘’“”–—', '''''""--'), '\\s+', ' ', 'g'))), 8) as light from documents""")
def loose_forms(spark, d):
    return docs(spark, d).select("doc_id", T.loose("text").alias("loose"), F.substring(F.md5(T.light_normalise("text")), 1, 8).alias("light"))


@R(f"""with {ITEMS}, s as (select item_id, name, regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '\\s*\\(\\d{{1,3}}\\)$', '') as stem from items), p as (select *, regexp_extract(stem, '_(\\d{{6}})_(\\d{{6}})$', 1) || regexp_extract(stem, '_(\\d{{6}})_(\\d{{6}})$', 2) as digits from s)
    select item_id, 'call' as form, regexp_extract(stem, '^Call (.*)_\\d{{6}}_\\d{{6}}$', 1) as party, strftime(try_strptime('20' || digits, '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') as moment, cast(case when name like '% (2).m4a' then 2 else 0 end as int) as copy, false as recovered from p""")
def filename_parse(spark, d):
    df = items(spark, d).select("item_id", T.parsed_name("name").alias("p"))
    return df.select("item_id", "p.form", "p.party", F.date_format("p.at", "yyyy-MM-dd HH:mm:ss").alias("moment"), F.coalesce("p.copy", F.lit(0)).alias("copy"), "p.recovered")


@R(f"""with {ITEMS} select item_id, left(sha256(cast(item_id as varchar)), 8) as tag, regexp_replace(regexp_replace(name, '[\\\\/:*?"<>|#%@]+', '-', 'g'), '^[-. ]+|[-. ]+$', '', 'g') as stem from items""")
def safe_stems(spark, d):
    return items(spark, d).select("item_id", T.id_tag("item_id").alias("tag"), T.safe_stem("name").alias("stem"))


LUHN = "(list_sum(list_transform(range(1, len(n) + 1), lambda i: case when (len(n) - i) % 2 = 0 then cast(n[i] as int) else case when 2 * cast(n[i] as int) > 9 then 2 * cast(n[i] as int) - 9 else 2 * cast(n[i] as int) end end)) % 10 = 0)"


@R(f"""with x as (select o_orderkey as item_id, cast(cast(7000101000000 + o_orderkey * 7919 as bigint) as varchar) as n from orders) select item_id, {LUHN} as luhn,
    len(n) = 13 and cast(n[3:4] as int) between 1 and 12 and cast(n[5:6] as int) between 1 and 31 and n[11] in ('0', '1') and {LUHN} as identity from x""")
def luhn_identifiers(spark, d):
    n = (F.lit(7000101000000) + F.col("o_orderkey") * 7919).cast("string")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), T.luhn(n).alias("luhn"), T.is_identity_number(n).alias("identity"))


@R("select page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) as host, regexp_replace(url, '[?#].*$', '') || case when contains(url, '?') then '?<redacted>' else '' end as shown from pages")
def urls_redacted(spark, d):
    return table(spark, d, "pages").select("page_id", T.host_of("url").alias("host"), T.redact_url("url").alias("shown"))


@R("select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) as digest from pages")
def html_escaped(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(T.html_escape("html")).alias("digest"))


@R("""select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp, greatest(0, date_diff('day', date '2024-01-10', cast(ts as date))) as days,
    printf('%02d:%02d:%02d', cast(floor(value * 100) as bigint) // 3600, cast(floor(value * 100) as bigint) // 60 % 60, cast(floor(value * 100) as bigint) % 60) as clock from events""")
def dates_and_clocks(spark, d):
    return table(spark, d, "events").select("event_id", T.stamp("ts").alias("stamp"), T.days_between(F.lit("2024-01-10"), F.date_format("ts", "yyyy-MM-dd")).cast("long").alias("days"), T.clock(F.col("value") * 100).alias("clock"))


@R("""with x as (select event_id, cast(floor(value * 50) as bigint) as s from events) select event_id, case when s < 60 then s || ' second' || case when s = 1 then '' else 's' end when s < 3600 then (s // 60) || ' minute' || case when s // 60 = 1 then '' else 's' end
    when s < 86400 then (s // 3600) || ' hour' || case when s // 3600 = 1 then '' else 's' end else (s // 86400) || ' day' || case when s // 86400 = 1 then '' else 's' end end as said from x""")
def human_durations(spark, d):
    return table(spark, d, "events").select("event_id", T.human_duration(F.col("value") * 50).alias("said"))


@R("""with x as (select o_orderkey as item_id, cast(floor(o_totalprice * o_totalprice) as bigint) as n from orders) select item_id, case when n < 1024 then n || ' B' when n < 1048576 then printf('%.1f', n / 1024) || ' KiB' when n < 1073741824 then printf('%.1f', n / 1048576) || ' MiB' else printf('%.1f', n / 1073741824) || ' GiB' end as said,
    (o % 900) * 1048576 as parsed from (select *, item_id as o from x)""")
def byte_sizes(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), T.format_bytes(F.floor(F.col("o_totalprice") * F.col("o_totalprice"))).alias("said"), T.parse_bytes(F.concat((F.col("o_orderkey") % 900).cast("string"), F.lit(" MiB"))).alias("parsed"))


@R("select o_orderkey as item_id, least(3600.0, 30.0 * power(2, o_orderkey % 12)) as span from orders")
def backoff_schedule(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), T.backoff(F.col("o_orderkey") % 12 + 1).alias("span"))


@R("select event_id, case when not isfinite(value / 50) then 0 else greatest(0.0, least(1.0, value / 50)) end as confidence from events")
def clamped_confidence(spark, d):
    return table(spark, d, "events").select("event_id", T.confidence(F.col("value") / 50).alias("confidence"))


@R("""with t as (select item_id, 'subject: s' || (item_id % 7) || chr(10) || 'Date: 2024-01-0' || (item_id % 9 + 1) || chr(10) || 'x-other: 1' || chr(10) || 'to: a: b' || chr(10) || chr(10) || text as t from benchmark)
    , h as (select item_id, split_part(t, chr(10) || chr(10), 1) as h from t) select item_id, trim(regexp_extract(h, '(?im)^subject:(.*)$', 1)) as subject, trim(regexp_extract(h, '(?im)^date:(.*)$', 1)) as date, trim(regexp_extract(h, '(?im)^to:(.*)$', 1)) as "to",
    len(list_distinct(list_transform(regexp_extract_all(h, '(?im)^(from|to|cc|subject|date|sent):', 1), lambda x: lower(x)))) as n from h""")
def header_parse(spark, d):
    k = F.col("item_id")
    t = F.concat(F.lit("subject: s"), k % 7, F.lit("\nDate: 2024-01-0"), k % 9 + 1, F.lit("\nx-other: 1\nto: a: b\n\n"), F.col("text"))
    h = T.header_map(t)
    return table(spark, d, "benchmark").select("item_id", *(F.element_at(h, c).alias(c) for c in ("subject", "date", "to")), F.size(h).alias("n"))


@R(f"""with t as (select item_id, 'subject: ' || case when item_id % 4 = 1 then 'other' else 'mine' end || case when item_id % 4 = 0 then '' else chr(10) || 'date: 2024-01-05 10:00:00 +02:00' end || chr(10) || chr(10) || case when item_id % 4 = 2 then 'write to a.b@example.com' else text end as t from benchmark),
    h as (select item_id, t, split_part(t, chr(10) || chr(10), 1) as h from t), p as (select item_id, [case when trim(regexp_extract(h, '(?im)^subject:(.*)$', 1)) <> 'mine' then 'subject differs' end, case when not regexp_matches(h, '(?im)^date:') then 'no date' end, case when regexp_matches(t, '{EMAIL}') then 'holds an address' end] as p from h)
    select item_id, array_to_string(list_filter(p, lambda x: x is not null), ',') as problems from p""")
def contract_check(spark, d):
    k = F.col("item_id") % 4
    t = F.concat(F.lit("subject: "), F.when(k == 1, "other").otherwise("mine"), F.when(k == 0, "").otherwise("\ndate: 2024-01-05 10:00:00 +02:00"), F.lit("\n\n"), F.when(k == 2, "write to a.b@example.com").otherwise(F.col("text")))
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.contract_problems(t, F.lit("mine")), ",").alias("problems"))


@R("""select conv_id, turn, list_contains(['user', 'system'], role) as known, case role when 'user' then 'on' when 'assistant' then 'off' else 'shadow' end as mode, case when role = 'user' then 'commercial' when role = 'assistant' then 'staff_matter' else 'system' end as category,
    case when role = 'assistant' then 'boss' when role = 'user' then 'rev' || (conv_id % 3) else 'boss' end as reviewer from conversations""")
def reviewer_routing(spark, d):
    df = table(spark, d, "conversations")
    role = F.col("role")
    cat = G.category(F.when(role == "user", "Price").when(role == "assistant", "staff matter").otherwise(role))
    by = F.when(role != "system", F.concat(F.lit("rev"), F.col("conv_id") % 3))
    return df.select("conv_id", "turn", role.isin("user", "system").alias("known"), G.mode(F.when(role == "user", " ON").when(role == "assistant", "off").otherwise("?")).alias("mode"), cat.alias("category"), G.reviewer(cat, by, "boss").alias("reviewer"))


@R("""select event_id, cast(floor(value) as bigint) as input, cast(floor(value) as bigint) + 1 as output, cast(case when event_id % 2 = 0 then 2 else 0 end as bigint) as cache_read, 0::bigint as cache_write from events""")
def token_usage(spark, d):
    v = F.floor("value").cast("long")
    one = F.concat(F.lit('{"input_tokens":'), v, F.lit(',"output_tokens":'), v + 1, F.lit("}"))
    two = F.concat(F.lit('{"prompt_tokens":'), v + 2, F.lit(',"completion_tokens":'), v + 1, F.lit(',"prompt_tokens_details":{"cached_tokens":2}}'))
    return table(spark, d, "events").select("event_id", T.token_usage(F.when(F.col("event_id") % 2 == 0, two).otherwise(one)).alias("u")).select("event_id", "u.*")


# --- entities -------------------------------------------------------------------------------------------------------

SITES = "sites as (select 'site-' || p_partkey as site, p_name || ' ' || p_brand || ' x' || (p_partkey % 300) || 'y' as title from part)"
TEXTS = "texts as (select p_partkey as doc_id, 'About the x' || (p_partkey % 300) || 'y and ' || p_brand || ' ' || p_name || ' or x' || (p_partkey % 7) || 'y' as text from part)"
VOCAB = "terms as (select distinct site, unnest(regexp_extract_all(lower(title), '[a-z0-9]+')) as term from sites), vocab as (select site, term from terms where length(term) >= 4 and term not in (select term from terms group by term having count(distinct site) > 8))"


def sites(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("site-"), "p_partkey").alias("site"), F.concat_ws(" ", "p_name", "p_brand", F.concat(F.lit("x"), F.col("p_partkey") % 300, F.lit("y"))).alias("title"))


def texts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("doc_id"), F.concat(F.lit("About the x"), k % 300, F.lit("y and "), "p_brand", F.lit(" "), "p_name", F.lit(" or x"), k % 7, F.lit("y")).alias("text"))


@R(f"with {SITES}, {VOCAB} select site, term from vocab")
def doc_freq_cut(spark, d):
    return E.site_vocabulary(sites(spark, d), 8)


SCORED = "words as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from texts), scored as (select doc_id, site, cast(sum(case when regexp_full_match(term, '[0-9]+') then 4 else 2 end) as bigint) as score from words join vocab using (term) group by 1, 2)"


@R(f"""with {SITES}, {TEXTS}, {VOCAB}, {SCORED}, top as (select doc_id, max(score) as score from scored group by 1), t as (select s.doc_id, s.score, count(*) as n, max(s.site) as site from scored s join top on s.doc_id = top.doc_id and s.score = top.score group by 1, 2)
    select texts.doc_id, case when n = 1 then site end as site, coalesce(score, 0) as score from texts left join t using (doc_id)""")
def entity_bind_tie_null(spark, d):
    return E.bind_sites(texts(spark, d), E.site_vocabulary(sites(spark, d), 8)).withColumn("score", F.coalesce("score", F.lit(0)))


@R(f"""with {SITES}, {TEXTS}, {VOCAB}, {SCORED}, r as (select *, row_number() over (partition by doc_id order by score desc, site) as place, coalesce(lead(score) over (partition by doc_id order by score desc, site), 0) as runner_up from scored) select * from r where place <= 3""")
def entity_ranked(spark, d):
    return E.ranked_sites(texts(spark, d), E.site_vocabulary(sites(spark, d), 8)).withColumn("place", F.col("place").cast("long")).withColumn("runner_up", F.coalesce("runner_up", F.lit(0)))


@R(f"""with {SITES}, {TEXTS}, {VOCAB}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from texts), n as (select doc_id, term, count(*) as n from w group by 1, 2) select doc_id, site, max(n) as mentions from n join vocab using (term) group by 1, 2""")
def mentions_max(spark, d):
    return E.mentions(texts(spark, d), E.site_vocabulary(sites(spark, d), 8))


LOOSE = "trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@R(f"""with {SITES}, {TEXTS}, tw as (select site, unnest(list_distinct(string_split({LOOSE.format('title')}, ' '))) as word from sites), n as (select site, count(*) as n from tw group by 1), w as (select doc_id, unnest(list_distinct(string_split({LOOSE.format('text')}, ' '))) as word from texts),
    s as (select doc_id, site, count(*) as shared from w join tw using (word) group by 1, 2) select doc_id, site, shared from s join n using (site) where 2 * shared >= n""")
def sites_named(spark, d):
    return E.named_sites(texts(spark, d), sites(spark, d))


SHINGLES = "(select distinct {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) as shingle from (select {key}, string_split({loose}, ' ') as w from {t}) where len(w) >= 5)"


@R(f"with a as {SHINGLES.format(key='doc_id', loose=LOOSE.format('text'), t='documents')}, b as {SHINGLES.format(key='item_id', loose=LOOSE.format('text'), t='benchmark')} select doc_id, item_id, count(*) as runs from a join b using (shingle) group by 1, 2")
def shingle_leak_join(spark, d):
    return E.leaks(docs(spark, d), table(spark, d, "benchmark"))


@R(f"""with q as (select doc_id as quote_id, doc_id, {LOOSE.format("substring(text, 11, 60)")} as quote, {LOOSE.format('text')} as hay from documents) select quote_id, doc_id, strpos(hay, quote) as place from q""")
def quotes_exact(spark, d):
    q = docs(spark, d).select(F.col("doc_id").alias("quote_id"), "doc_id", F.substring("text", 11, 60).alias("quote"))
    return E.exact_quotes(q, docs(spark, d)).select("quote_id", "doc_id", F.col("at").cast("long").alias("place"))


@R(r"""with f as (select doc_id, [case when regexp_matches(text, '(^|[^A-Za-z])[0-9]([^A-Za-z]|$)') then 'number' end,
    case when regexp_matches(text, '(?i)\b\d{4}-\d{2}-\d{2}\b|\b(?:monday|tuesday|wednesday|thursday|friday|saturday|sunday|today|tomorrow|yesterday|deadline|overdue)\b') then 'date' end,
    case when regexp_matches(text, '(?i)%|\b(?:percent|price|quote|invoice|cost|budget|deposit|payment|paid)\b') then 'amount' end, case when regexp_matches(text, '(?i)\b(?:approv(?:e|ed|al)|agreed?|accepted|confirm(?:ed)?|permission|proceed)\b') then 'approval' end,
    case when regexp_matches(text, '(?i)\b(?:i''?ll|we''?ll|i will|we will|going to|promised?|must|need to|have to)\b') then 'promise' end, case when regexp_matches(text, '(?i)\b(?:plumb|electric|roof|concrete|paint|tiling|window|door)\w*\b') then 'trade' end] as t from documents)
    select doc_id, array_to_string(list_filter(t, lambda x: x is not null), ',') as triggers from f""")
def precheck_triggers(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(E.precheck(F.col("text")), ",").alias("triggers"))


@R("""with w as (select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))) as words, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')), lambda x: lower(regexp_replace(x, '^[.,;:!?"''()\\[\\]]+|[.,;:!?"''()\\[\\]]+$', '', 'g'))) as l,
      case when doc_id % 17 = 0 then null else n_chars / 14.0 * (1 + doc_id % 9) end as duration, doc_id % 31 = 0 as truncated, n_chars / 14.0 * (doc_id % 5) / 2 as covered from documents), r as (select *, case when len(l) > 0 then len(list_distinct(l)) / len(l) else 1.0 end as ratio from w)
    select doc_id, case when truncated then 'implausible' when words = 0 and duration is null then 'implausible' when words = 0 and duration <= 90 then 'silent' when words = 0 then 'implausible' when duration is null then 'plausible'
      when duration <= 0 or duration > 20 and (words / (duration / 60) < 25 or words / (duration / 60) > 400) or duration > 20 and covered / duration < 0.5 or words >= 60 and ratio < 0.08 then 'implausible' else 'plausible' end as verdict from r""")
def plausibility_verdict(spark, d):
    k = F.col("doc_id")
    duration = F.when(k % 17 != 0, F.col("n_chars") / 14.0 * (1 + k % 9))
    said = docs(spark, d).select("doc_id", "n_chars", T.spoken_words("text").alias("words")).select("doc_id", "n_chars", F.size("words").alias("n"), T.distinct_ratio(F.col("words")).alias("ratio"))
    return said.select("doc_id", E.plausibility(F.col("n"), duration, k % 31 == 0, F.col("n_chars") / 14.0 * (k % 5) / 2, F.col("ratio")).alias("verdict"))


@R()
def proper_noun_triggers(spark, d):
    return docs(spark, d).select("doc_id", E.proper_nouns(F.col("text")).alias("names"))


@R()
def dictated_addresses(spark, d):
    t = F.concat(F.lit("ask carel at example dot co dot za, item "), F.col("item_id"))
    return table(spark, d, "benchmark").select("item_id", T.contains_dictated(t).alias("flagged"), T.strip_dictated(t).alias("said"))


# --- matching and the gate: beyond SQL ------------------------------------------------------------------------------


@R()
def nfkc_normalise(spark, d):
    return docs(spark, d).select("doc_id", F.md5(M.normalise("text")).alias("digest"))


@R()
def fuzzy_quotes(spark, d):
    """Quotes from the middle of each turn, one word changed in every third."""
    df = table(spark, d, "conversations")
    q = F.substring("text", 21, 90)
    q = F.when(F.col("turn") % 3 == 0, F.regexp_replace(q, r"^(\S+ \S+ )\S+", "$1other")).otherwise(q)
    return df.select("conv_id", "turn", M.verify_quote(q, F.col("text")).alias("c")).select("conv_id", "turn", "c.*")


@R()
def quote_locations(spark, d):
    df = table(spark, d, "conversations")
    return df.select("conv_id", "turn", M.locate_spans(F.substring("text", 5, 40), F.col("text")).alias("spans"))


@R()
def redacted_texts(spark, d):
    df = table(spark, d, "benchmark")
    words = F.substring("text", 31, 50)
    spans = F.array(F.struct(F.lit(30).cast("int").alias("start"), words.alias("words"), F.upper(F.substring(F.sha2(words, 256), 1, 6)).alias("ref")))
    out = df.select("item_id", M.redact_text(F.col("text"), spans).alias("text"), spans.alias("spans"))
    return out.select("item_id", "text", F.size(M.leaked_refs(F.col("text"), F.col("spans"))).alias("leaks"))


@R()
def rule_findings(spark, d):
    return G.rule_findings(docs(spark, d))


@R()
def gate_assessed(spark, d):
    """Rules' findings with a stand-in for a model's: the second hundred characters, as sure as the document's number says."""
    rules = G.rule_findings(docs(spark, d))
    model = docs(spark, d).where("n_chars > 200").select("doc_id", F.lit(100).alias("start"), F.lit(200).alias("end"), F.lit("commercial").alias("category"), F.lit("model").alias("rule"), ((F.col("doc_id") % 10) / 10).alias("confidence"), F.lit("model").alias("source"))
    held, labelled = G.assessed(rules, model)
    return held.select("doc_id", "start", "end", F.lit("held").alias("band")).unionByName(labelled.select("doc_id", "start", "end", F.lit("labelled").alias("band")))


# --- reports --------------------------------------------------------------------------------------------------------


@R(f"""with {ITEMS}, d as (select route, left(discovered_at, 10) as day, count(*) as a, count(*) filter (state = 'DONE') as done, count(*) filter (state = 'QUARANTINED') as q, count(*) filter (state not in ('DONE', 'QUARANTINED', 'SKIPPED_EMPTY', 'ERASED')) as f from items group by 1, 2)
    select route, day, day || ': ' || case when q > 0 then q || ' to look at; ' else '' end || case when a = 0 then 'nothing arrived' when done = a and f = 0 then 'all ' || done || ' done' else done || ' of ' || a || ' done' || case when f > 0 then ', ' || f || ' waiting' else '' end end as subject from d""")
def report_subjects(spark, d):
    from siltstone.functions.report import subject
    from siltstone.operators.ledger import cohort

    df = cohort(items(spark, d))
    return df.select("route", "day", subject(F.col("day"), F.col("discovered"), F.col("done"), F.col("quarantined"), F.col("in_flight")).alias("subject"))


@R("select event_id, strftime(ts + interval 2 hour, '%d%m%y %H%M') as typed, strftime(ts + interval 2 hour, '%Y-%m-%d %H:%M') as local from events")
def local_stamps(spark, d):
    from siltstone.functions.report import local, typed_stamp

    t = local(F.col("ts").cast("timestamp"), "Africa/Johannesburg")
    return table(spark, d, "events").select("event_id", typed_stamp(t).alias("typed"), F.date_format(t, "yyyy-MM-dd HH:mm").alias("local"))


@R()
def held_contexts(spark, d):
    """Each passage's first hundred characters with two held spans replaced."""
    from siltstone.functions.report import context

    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(r).alias("ref")) for a, b, r in ((10, 20, "AAAAAA"), (15, 40, "BBBBBB"))))
    return table(spark, d, "benchmark").select("item_id", context("text", F.lit(0), F.lit(100), spans).alias("context"))
