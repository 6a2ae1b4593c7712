"""The gate over texts: rules that hold passages, model findings, bands merged, what must not leave."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.matching import sentence_spans, snap
from siltstone.operators.windows import islands, subtract

# --- spoken requests ------------------------------------------------------------------------------------------------
#
# A request is a frame: parts that follow each other in one line of one sentence.  A part is a choice of phrases ("a|b c"),
# a choice that may be missing (in brackets: "[a|b]"), or how many other words may stand between its neighbours.

#: The words of the frames, by language.
NOT_EN = "don't|do not|never"
IT_EN = "this|that|it"
RECORD_EN = "report|minutes|record|note|notes|write-up|write up|writeup|file|system|email"
KEPT_EN = "off the record|between us|to yourself|quiet"
US_EN = "you and me|you and i|us two|ourselves|the two of us"
DOWN_AF = "neerskryf|neergeskryf|opskryf|opgeskryf|aanteken|aangeteken|notuleer"
#: isiXhosa and isiZulu forms of "do not write", which mean nothing else.
DO_NOT_WRITE_NGUNI = "ungakubhali|ungabhali|ungayibhali|ungazibhali|ungakulobi|ungalobi|sukubhala|sukukubhala|ningabhali|ningakubhali|musa ukubhala|musa ukukubhala|musani ukubhala|musani ukukubhala"
INSIDE = "firm|office|room|building|company"

FRAMES: dict[str, tuple[tuple[str | int, ...], ...]] = {
    "do_not_write_down": (
        (NOT_EN, 5, "write|writes|writing|written", 4, "down"),
        (NOT_EN, 4, "put|include|type|log", 5, "in|into", "[the]", RECORD_EN),
        (NOT_EN, "minute|record", IT_EN),
        ("off|not for", "the record"),
        (IT_EN, "doesn't|does not|mustn't|must not|is not to", "go", "in|into|on"),
        ("keep", IT_EN, KEPT_EN),
        ("between", US_EN),
        ("strike|leave", IT_EN, "from|out of", "the", RECORD_EN),
        ("moenie", 7, DOWN_AF),
        ("moenie", 7, "skryf", 3, "neer"),
        ("hou|bly", "[dit|hierdie|hierso]", "tussen ons"),
        ("nie vir die rekord|buite die rekord",),
        (DO_NOT_WRITE_NGUNI,),
    ),
    "legal_exposure": (("mustn't|must not|cannot|can not|shouldn't|should not|mag nie", 4, "leave", "[this|the|our]", INSIDE),),
}

#: Words beside which a run of digits is an account's, and those beside which it is something else's.
ACCOUNT = "account|acc|acct|a/c|bank|banking|branch code|iban|swift|card|cvv|rekening|rekeningnommer|bankrekening|takkode|kaartnommer|kredietkaart|iakhawunti|i-akhawunti|inombolo ye-akhawunti|inombolo yeakhawunti"
NO_ACCOUNT = "invoice|inv|order|po|certificate|cert|erf|stand|unit|plot|portion|reference|ref|quote|quotation|job|ticket|serial|vat|meter"
_GAP = r"[,;:]?[^\S\n]+"


def _choice(phrases: str) -> str:
    """Whole phrases in any spacing; an apostrophe in any shape, or left out."""
    spelt = [r"[^\S\n]+".join(re.escape(w).replace("'", "\\s?['’]?") if "n't" not in w else re.escape(w).replace("n't", r"\s?n['’]?t") for w in x.split()) for x in phrases.split("|")]
    return rf"(?<!\w)(?:{'|'.join(sorted(spelt, key=len, reverse=True))})(?!\w)"


def _compiled(parts: tuple[str | int, ...]) -> re.Pattern[str]:
    out = ""
    for k, part in enumerate(parts):
        if isinstance(part, int):
            out += rf"(?:[^\s.!?]+{_GAP}){{0,{part}}}?"
        elif part[0] == "[":
            out += rf"(?:{_choice(part[1:-1])}{_GAP})?"
        else:
            out += _choice(part) + (_GAP if k + 1 < len(parts) else "")
    return re.compile(out, re.I)


def _signs(parts: tuple[str | int, ...]) -> tuple[str, ...]:
    """Of the part whose phrases are the longest: what a text has to hold, so that most texts are not searched further."""
    must = [x.split("|") for x in parts if isinstance(x, str) and x[0] != "["]
    return tuple(w.split()[-1].split("'")[0] for w in max(must, key=lambda ws: min(len(w.split()[-1].split("'")[0]) for w in ws)))


_FRAMES = [(category, f"{category}/{k}", _signs(parts), _compiled(parts)) for category, frames in FRAMES.items() for k, parts in enumerate(frames)]
_ACCOUNT, _NO_ACCOUNT = (re.compile(_choice(x), re.I) for x in (ACCOUNT, NO_ACCOUNT))
_DIGITS = re.compile(r"\d+(?:\s?[\s-]\s?\d+|-\d+)*")


def _luhn(digits: str) -> bool:
    return sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0


def _identity(d: str) -> bool:
    return len(d) == 13 and 1 <= int(d[2:4]) <= 12 and 1 <= int(d[4:6]) <= 31 and d[10] in "01" and _luhn(d)


def _numbers(text: str) -> list[tuple[int, int, str]]:
    """(start, end, rule) of identity, card and account numbers.

    A run of digits may be written in groups.  Of a run's successive groups the first and longest that make an identity
    number are one, then those that make a card's; what is left of 6 to 24 digits is an account's if a word before says so."""
    out = []
    for run in _DIGITS.finditer(text):
        if sum(map(str.isdigit, run[0])) < 6 or run.start() and text[run.start() - 1] in ",.":
            continue
        groups = [(m.start() + run.start(), m.end() + run.start()) for m in re.finditer(r"\d+", run[0])]
        before = text[max(0, run.start() - 40) : run.start()]
        other = bool(_NO_ACCOUNT.search(before))

        def take(test, rule: str, groups=groups) -> bool:  # noqa: ANN001
            for i in range(len(groups)):
                for j in range(len(groups), i, -1):
                    d = "".join(text[a:b] for a, b in groups[i:j])
                    if test(d):
                        out.append((groups[i][0], groups[j - 1][1], rule))
                        del groups[i:j]
                        return True
            return False

        while take(_identity, "identity"):
            pass
        while not other and take(lambda d: 13 <= len(d) <= 19 and _luhn(d), "card"):
            pass
        if groups and not other and 6 <= sum(b - a for a, b in groups) <= 24 and _ACCOUNT.search(before):
            out.append((groups[0][0], groups[-1][1], "account"))
    return out


def without(text: str, own: Sequence[str]) -> str:
    """H7: the text with this service's own identifiers blanked, so that no rule takes them for somebody's; offsets stay."""
    for name in sorted(filter(None, own), key=len, reverse=True):
        text = text.replace(name, " " * len(name))
    return text


def findings_in(text: str, own: Sequence[str] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, category, rule) of all rules.  A spoken request holds its sentence and one on either side."""
    out: set[tuple[int, int, str, str]] = set()
    searched = without(text, own)
    low, sentences = searched.lower(), None
    for category, rule, signs, frame in _FRAMES:
        if not any(s in low for s in signs):
            continue
        for m in frame.finditer(searched):
            sentences = sentences if sentences is not None else sentence_spans(text)
            mine = [i for i, (s, e) in enumerate(sentences) if s <= m.start() < e]
            a, b = (sentences[max(0, mine[0] - 1)][0], sentences[min(len(sentences) - 1, mine[0] + 1)][1]) if mine else m.span()
            out.add((*snap(text, a, b), category, rule))
    out |= {(*snap(text, a, b), "bare_identifier", rule) for a, b, rule in _numbers(searched)}
    return sorted(out)


def rule_findings(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, category, rule, confidence, source."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = [(i, *f) for i, t in zip(df.doc_id, df.text, strict=True) for f in findings_in(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "category", "rule"])

    found = docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start int, end int, category string, rule string")
    return found.withColumns({"confidence": F.lit(1.0), "source": F.lit("rule")})


def merged(findings: DataFrame) -> DataFrame:
    """overlapping findings of a document as one; the most certain (a rule before a model) names it."""
    lead = F.max_by(F.struct("category", "rule"), F.struct("confidence", (F.col("source") == "rule").alias("is_rule"), (-F.col("start")).alias("s"))).alias("lead")
    df = islands(findings, ["doc_id"], "start", "end", 0, [lead, F.max("confidence").alias("confidence"), F.bool_or(F.col("source") == "rule").alias("by_rule")])
    return df.select("doc_id", "start", "end", "n", "lead.category", "lead.rule", "confidence", "by_rule")


def assessed(rules: DataFrame, model: DataFrame, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Held and merely labelled passages.  A model's finding under `least` is labelled, not held; labelled ones lose what is held."""
    sure = model.where(F.col("confidence") >= least)
    held = merged(rules.unionByName(sure.select(*rules.columns)))
    labelled = islands(model.where(F.col("confidence") < least), ["doc_id"], "start", "end").drop("n")
    return held, subtract(labelled, held.select("doc_id", "start", "end"), ["doc_id"])


def covering(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans that a finding of their document covers in part."""
    f = findings.select("doc_id", F.col("start").alias("fs"), F.col("end").alias("fe"))
    return spans.join(f, "doc_id").where("start < fe and fs < end").select(*spans.columns).distinct()


def held_size(findings: DataFrame) -> DataFrame:
    """Passages and characters by category."""
    return findings.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def reviewer(category: Column, recorded_by: Column, principal: str) -> Column:
    """I37."""
    return F.when(recorded_by.isNull() | (recorded_by == ""), F.lit(principal)).when((category == "staff_matter") & F.lit(bool(principal)), F.lit(principal)).otherwise(recorded_by)


CATEGORIES = {"commercial": "commercial", "money": "commercial", "price": "commercial", "staff": "staff_matter", "staff_matter": "staff_matter", "legal": "legal_exposure", "legal_exposure": "legal_exposure", "identifier": "bare_identifier", "bare_identifier": "bare_identifier", "personal": "personal", "do_not_write_down": "do_not_write_down"}


def category(value: Column) -> Column:
    """An alias's category; others stay as they are."""
    v = F.lower(F.trim(F.translate(value, " -", "__")))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), v), v)


def mode(value: Column) -> Column:
    """Off, shadow or on; anything else is shadow."""
    v = F.lower(F.trim(value))
    return F.when(v.isin("off", "shadow", "on"), v).otherwise("shadow")


def subject(offered: Column, of_category: Column) -> Column:
    """A short phrase without digits or addresses, else the category's own words."""
    return F.when(F.length(offered).between(3, 60) & ~offered.rlike(r"[0-9@\n]"), offered).otherwise(F.concat(F.lit("a matter of "), F.translate(of_category, "_", " ")))
