"""The relational part of analysis: a model's nested answer, its quotes checked, split and masked; vocabulary sent along."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import matching as M
from siltstone.functions.text import strip_dictated, strip_emails

#: The kinds of entry in an answer, and its field names.
CATEGORIES = ("decisions", "commitments", "money", "materials", "defects", "safety", "programme", "open_questions", "follow_ups")
_ITEM = "struct<summary string, quote string, speaker string, site string, confidence double>"
_COMMITMENT = "struct<owner string, what string, by_when string, quote string, speaker string, site string, confidence double>"
_PASSAGE = "struct<quote string, category string, who_is_harmed string, what_it_is string, reason string, confidence double>"
_LISTS = {"participants": "array<struct<name_or_role string, quote string>>"} | {c: f"array<{_COMMITMENT if c == 'commitments' else _ITEM}>" for c in CATEGORIES}
ANSWER = ", ".join((
    "summary_en string, languages array<string>, site struct<name string, quote string>", *(f"{c} {t}" for c, t in _LISTS.items()), f"unclear_passages array<struct<passage string, why string>>, sensitive_passages array<{_PASSAGE}>",
))
REQUIRED = ("summary_en", "languages", "participants", "site", *CATEGORIES, "unclear_passages")


def read_answers(answers: DataFrame, sensitive: bool = False) -> DataFrame:
    """item_id, answer (struct) and the required fields that it lacks; what is no JSON object lacks them all.  answers: item_id, body."""
    asked = (*REQUIRED, "sensitive_passages") if sensitive else REQUIRED
    keys = F.coalesce(F.json_object_keys("body"), F.array().cast("array<string>"))
    return answers.select("item_id", F.from_json("body", ANSWER).alias("answer"), F.array_except(F.array(*map(F.lit, asked)), keys).alias("lacking"))


def _clean(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit("")))


def _entry(category: str, site: Column) -> Callable[[Column], Column]:
    """One shape for the entries of all categories; a commitment is said in reported speech."""

    def shaped(e: Column) -> Column:
        if category == "commitments":
            what, owner = F.regexp_replace(_clean(e["what"]), r"\.+$", ""), _clean(e["owner"])
            summary = F.when(what == "", "").when(owner != "", F.concat(owner, F.lit(" is reported as undertaking: "), what)).otherwise(F.concat(F.lit("undertaken by someone unnamed: "), what))
            due = F.nullif(_clean(e["by_when"]), F.lit(""))
        else:
            summary, due = _clean(e["summary"]), F.lit(None).cast("string")
        at = F.nullif(_clean(e["site"]), F.lit(""))
        return F.struct(F.lit(category).alias("category"), summary.alias("summary"), due.alias("due"), _clean(e["quote"]).alias("quote"), F.nullif(_clean(e["speaker"]), F.lit("")).alias("speaker"), F.coalesce(at, site).alias("site"), e["confidence"].alias("confidence"))

    return shaped


@F.pandas_udf(T.ArrayType(M.CHECK))
def checked_quotes(quotes: pd.Series, text: pd.Series) -> pd.Series:
    """Each quote of a row against the row's text, which is sent to Python once."""
    return pd.Series([[M.check_quote(q, t) for q in qs] if qs is not None else [] for qs, t in zip(quotes, text, strict=True)])


def assembled(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """item_id, place, category, summary, due, quote, speaker, site, confidence, kind, reason: every entry of an answer, once.

    texts: item_id, text; answers: as read_answers gives them.  An entry with words that the transcript has is a proposal, and
    its quote is the transcript's own; any other is for review with the reason.  Participants and the site are checked alike,
    addresses are masked.  The text meets its answer once, entries are exploded after the check."""
    a = F.col("answer")
    site = F.nullif(_clean(a["site"]["name"]), F.lit(""))
    some = lambda c: F.coalesce(a[c], F.array().cast(_LISTS[c]))
    lists = [F.transform(some(c), _entry(c, site)) for c in CATEGORIES]
    shape = lambda category, summary, quote: F.struct(F.lit(category).alias("category"), summary.alias("summary"), F.lit(None).cast("string").alias("due"), _clean(quote).alias("quote"), F.lit(None).cast("string").alias("speaker"), site.alias("site"), F.lit(None).cast("double").alias("confidence"))
    people = F.transform(F.filter(some("participants"), lambda p: _clean(p["name_or_role"]) != ""), lambda p: shape("participants", _clean(p["name_or_role"]), p["quote"]))
    place = F.when(site.isNotNull(), F.array(shape("site", site, a["site"]["quote"]))).otherwise(F.array().cast("array<struct<category:string,summary:string,due:string,quote:string,speaker:string,site:string,confidence:double>>"))
    df = texts.select("item_id", "text").join(answers.select("item_id", "answer"), "item_id").select("item_id", "text", F.concat(people, place, *lists).alias("entries"))
    df = df.withColumn("checks", checked_quotes(F.transform("entries", lambda e: e["quote"]), F.col("text")))
    own = F.transform("checks", lambda c: F.when(c["ok"], F.expr("text").substr(c["start"] + 1, c["end"] - c["start"])))
    df = df.select("item_id", F.posexplode(F.arrays_zip("entries", "checks", own.alias("own"))).alias("place", "z"))
    e, ok = F.col("z.entries"), F.col("z.checks.ok")
    reason = F.when(e["summary"] == "", "no description").when(e["quote"] == "", "no quote").when(~ok, "the words are not in the text")
    mask = lambda x: strip_dictated(strip_emails(x))
    return df.select("item_id", "place", e["category"].alias("category"), mask(e["summary"]).alias("summary"), e["due"].alias("due"), strip_emails(F.coalesce(F.when(ok, F.col("z.own")), e["quote"])).alias("quote"), e["speaker"].alias("speaker"), F.when(e["site"].isNotNull(), mask(e["site"])).alias("site"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(e["confidence"], F.lit(0.0)))).alias("confidence"), F.when(reason.isNull(), "proposal").otherwise("review").alias("kind"), reason.alias("reason"))


def unclear(texts: DataFrame, answers: DataFrame) -> DataFrame:
    """Passages that the model could not read, and whether the transcript has them."""
    a = answers.select("item_id", F.filter(F.col("answer.unclear_passages"), lambda p: _clean(p["passage"]) != "").alias("p"))
    df = texts.select("item_id", "text").join(a, "item_id").where(F.size("p") > 0)
    df = df.withColumn("ok", F.transform(checked_quotes(F.transform("p", lambda x: x["passage"]), F.col("text")), lambda c: c["ok"]))
    return df.select("item_id", F.inline(F.arrays_zip(F.transform("p", lambda x: strip_emails(_clean(x["passage"]))).alias("passage"), F.transform("p", lambda x: strip_emails(_clean(x["why"]))).alias("why"), F.col("ok").alias("found"))))


# --- held words in derived records ------------------------------------------------------------------------------------


def _masked(value, spans: Sequence[dict]):  # noqa: ANN001, ANN202
    if isinstance(value, str):
        return M.mask(value, spans)
    if isinstance(value, list):
        return [_masked(v, spans) for v in value]
    return {k: _masked(v, spans) for k, v in value.items()} if isinstance(value, dict) else value


@F.pandas_udf(T.StringType())
def mask_record(record: pd.Series, spans: pd.Series) -> pd.Series:
    """A JSON record with held words masked in every string, however deep; what is no JSON is masked as text."""

    def one(text: str | None, held: Sequence[dict] | None) -> str | None:
        if text is None or held is None or not len(held):
            return text
        try:
            return json.dumps(_masked(json.loads(text), held), ensure_ascii=False)
        except ValueError:
            return M.mask(text, held)

    return pd.Series([one(t, s) for t, s in zip(record, spans, strict=True)])


@F.pandas_udf(T.StringType())
def swallowed_by(quote: pd.Series, spans: pd.Series) -> pd.Series:
    """The ref of the first held passage that has all of a quote's words; null if none."""

    def one(q: str | None, held: Sequence[dict] | None) -> str | None:
        needle = M.normalised(q)[0].strip()
        return next((s["ref"] for s in (held if held is not None else ()) if needle and needle in M.normalised(s["words"])[0]), None)

    return pd.Series([one(q, s) for q, s in zip(quote, spans, strict=True)])


def without_held(proposals: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals with held words masked, and those that are held as a whole, with the ref.  spans: item_id, spans."""
    df = proposals.join(spans.select("item_id", "spans"), "item_id", "left").withColumn("ref", swallowed_by(F.col("quote"), F.col("spans")))
    kept = df.where("ref is null").withColumns({c: F.when(F.col(c).isNotNull(), M.mask_text(F.col(c), F.col("spans"))) for c in ("summary", "quote")})
    return kept.select(*proposals.columns), df.where("ref is not null").select("item_id", "place", "ref")


#: How the question about a held passage ends, and how long a question may be.
QUESTION_END, QUESTION = "may it be released into the record?", r"[^.!?\n]{15,240}\?"


def held_line(ref: Column, phrase: Column, day: Column, question: Column) -> Column:
    """The line that stands for a held passage: what it is, when it was said, and the question to its reviewer."""
    return F.concat(F.lit("- Held passage "), ref, F.lit(", "), phrase, F.lit(", recorded "), day, F.lit(". "), question)


def harvestable(line: Column) -> Column:
    """The question that a reader of the record would lift out of such a line; empty if there is none."""
    found = F.filter(F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(rf"(?:^|[.!?\n])\s*({QUESTION})"), F.lit(1)), lambda q: F.contains(q, F.lit(QUESTION_END)))
    return F.coalesce(F.trim(F.get(found, F.lit(0))), F.lit(""))


# --- vocabulary -------------------------------------------------------------------------------------------------------


def vocabulary_sent(terms: Column, counterparty: Column, most: int = 100) -> Column:
    """H4: terms without addresses, each once whatever its case, the first so many; the counterparty before them unless it is one."""
    clean = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(strip_emails(F.trim(t)))), lambda t: t != "")
    lower = F.transform(clean, lambda t: F.lower(t))
    firsts = F.slice(F.filter(clean, lambda t, i: F.array_position(lower, F.lower(t)) == i + 1), 1, most)
    name = F.trim(strip_emails(F.trim(F.coalesce(counterparty, F.lit("")))))
    new = (name != "") & ~F.array_contains(F.transform(firsts, lambda t: F.lower(t)), F.lower(name))
    return F.when(new, F.concat(F.array(name), firsts)).otherwise(firsts)


def declared_routes(value: Column) -> Column:
    """H5: a comma-separated setting as struct of routes and problems, none of which hides another."""
    names = F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    good = F.filter(names, lambda x: x.rlike("^[a-z0-9][a-z0-9-]*$"))
    bad = F.transform(F.array_except(names, good), lambda x: F.concat(F.lit("not a slug: "), x))
    twice = F.transform(F.array_distinct(F.filter(good, lambda x, i: F.array_position(good, x) < i + 1)), lambda x: F.concat(F.lit("declared twice: "), x))
    return F.struct(F.array_distinct(good).alias("routes"), F.concat(bad, twice, F.when(F.size(names) == 0, F.array(F.lit("no route is declared"))).otherwise(F.array().cast("array<string>"))).alias("problems"))
