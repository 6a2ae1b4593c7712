"""Short texts for people: moments, subject lines, contexts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.text import EMAIL


def local(ts: Column, zone: str) -> Column:
    """I18."""
    return F.from_utc_timestamp(ts, zone)


def friendly(ts: Column, zone: str) -> Column:
    """I86."""
    return F.date_format(local(ts, zone), "EEEE d MMMM yyyy, HH:mm")


def typed_stamp(ts: Column) -> Column:
    """Day first, as people type it."""
    return F.date_format(ts, "ddMMyy HHmm")


def phrase_at(text: Column, phrase: str) -> Column:
    """Where a phrase stands as whole words, from 1; 0 if nowhere."""
    import re

    body = r"\s+".join(re.escape(w) for w in phrase.split())
    return F.regexp_instr(text, F.lit(rf"(?iU)(?<!\w){body}(?!\w)"))


def looks_like_address(value: Column) -> Column:
    """I98."""
    return F.coalesce(value.rlike(EMAIL.replace("(?i)", "(?i)^", 1) + "$"), F.lit(False))


def routes_said(text: Column) -> Column:
    """The two routes that a disagreement's wording names."""
    found = F.regexp_extract_all(text, F.lit(r"route '([a-z0-9-]+)'"), F.lit(1))
    return F.when(F.size(found) >= 2, F.slice(found, 1, 2)).otherwise(F.array().cast("array<string>"))


def shifted(segments: Column, seconds: Column) -> Column:
    """Segments (start, end, text) moved in time."""
    return F.transform(segments, lambda s: F.struct((s["start"] + seconds).alias("start"), (s["end"] + seconds).alias("end"), s["text"].alias("text")))


def digests(content: Column) -> Column:
    """I64: the hashes by which a file is known."""
    return F.struct(F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"))


def subject(day: Column, arrived: Column, done: Column, failed: Column, queued: Column) -> Column:
    """A report's subject; what needs a person comes first."""
    count = lambda n, word: F.concat(n.cast("string"), F.lit(f" {word}"))
    rest = F.when(arrived == 0, "nothing arrived").when((done == arrived) & (queued == 0), F.concat(F.lit("all "), count(done, "done"))).otherwise(F.concat(count(done, "of"), F.lit(" "), count(arrived, "done"), F.when(queued > 0, F.concat(F.lit(", "), count(queued, "waiting"))).otherwise("")))
    return F.concat(day, F.lit(": "), F.when(failed > 0, F.concat(count(failed, "to look at"), F.lit("; "))).otherwise(""), rest)


@F.pandas_udf(T.StringType())
def context(text: pd.Series, start: pd.Series, end: pd.Series, others: pd.Series) -> pd.Series:
    """A window of a text with other held spans (start, end, ref) replaced by their refs."""

    def one(t: str, a: int, b: int, spans) -> str:  # noqa: ANN001
        out, at = [], a
        for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
            lo, hi = max(at, s["start"]), min(b, s["end"])
            if lo < hi:
                out += [t[at:lo], f"[held {s['ref']}]"]
                at = hi
        return "".join(out) + t[at:b]

    return pd.Series([one(*x) for x in zip(text, start, end, others, strict=True)])
