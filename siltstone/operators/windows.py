"""Sequential operators: sessions, interval unions and differences, admission under a budget, overlaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, by: Sequence[str], start: str, end: str, gap: int = 0, lead: Sequence[Column] = ()) -> DataFrame:
    """unions of intervals that overlap or lie at most gap apart, with start, end, n and the lead's attributes.

    A running maximum of the ends before marks where an island begins; no row is compared with all others.  Unknown starts
    and ends come last, as in DuckDB: such rows count into the island before them."""
    w = Window.partitionBy(*by).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = spans.withColumn("_new", F.when(before.isNull() | (F.col(start) > before + gap), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n"), *lead).drop("_island")


def subtract(labelled: DataFrame, held: DataFrame, by: Sequence[str], least: int = 3) -> DataFrame:
    """Labelled intervals (by, start, end) without what held ones cover; pieces under `least` are dropped.

    A sweep over the edges of both: between two edges everything is constant, so a piece is kept where some labelled and
    no held interval is open.  Rows grow with the edges, not with overlapping pairs."""
    edge = lambda df, a, b: df.select(*by, F.explode(F.array(F.struct(F.col("start").alias("x"), F.lit(a).alias("l"), F.lit(b).alias("h")), F.struct(F.col("end").alias("x"), F.lit(-a).alias("l"), F.lit(-b).alias("h")))).alias("e")).select(*by, "e.*")
    edges = edge(labelled, 1, 0).unionByName(edge(held, 0, 1)).groupBy(*by, "x").agg(F.sum("l").alias("l"), F.sum("h").alias("h"))
    w = Window.partitionBy(*by).orderBy("x")
    df = edges.select(*by, F.col("x").alias("start"), F.lead("x").over(w).alias("end"), F.sum("l").over(w).alias("l"), F.sum("h").over(w).alias("h"))
    pieces = df.where("l > 0 and h = 0 and end is not null").select(*by, "start", "end")
    return islands(pieces, by, "start", "end").drop("n").where(F.col("end") - F.col("start") >= least)


def overlaps(a: DataFrame, b: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of a and b that overlap, within equal keys."""
    other = b.select(*by, F.col("start").alias("other_start"), F.col("end").alias("other_end"))
    return a.join(other, list(by)).where("start < other_end and other_start < end")


def sessions(words: DataFrame, by: Sequence[str], max_gap: float) -> DataFrame:
    """F3 without its length rule: runs of one speaker with pauses of at most max_gap.  words: by, start, end, speaker, text."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    new = F.lag("end").over(w).isNull() | ~F.lag("speaker").over(w).eqNullSafe(F.col("speaker")) | (F.col("start") - F.lag("end").over(w) > max_gap)
    df = words.withColumn("session", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "end", "text"))), lambda x: x["text"]), " ")
    return df.groupBy(*by, "session").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("speaker").alias("speaker"), text.alias("text"))


def segments(words: DataFrame, by: Sequence[str], max_gap: float = 0.9, max_chars: int = 320) -> DataFrame:
    """F3 whole: a segment also ends once its text has max_chars.  Where the next one begins depends on all before it, so
    each recording's ordered words are folded; the fold is bounded by a recording."""
    ordered = words.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("start", "end", "speaker", "text"))).alias("w"))
    seg = "struct<start:double,end:double,speaker:string,text:string>"
    start = F.array().cast(f"array<{seg}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        one = lambda a, b, c, d: F.struct(a.cast("double").alias("start"), b.cast("double").alias("end"), c.alias("speaker"), d.alias("text"))
        fresh = (F.size(acc) == 0) | ~last["speaker"].eqNullSafe(x["speaker"]) | (x["start"] - last["end"] > max_gap) | (F.length(last["text"]) >= max_chars)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(last["start"], F.greatest(last["end"], x["end"]), last["speaker"], F.concat_ws(" ", last["text"], x["text"]))))
        return F.when(F.size(acc) == 0, F.array(one(x["start"], x["end"], x["speaker"], x["text"]))).when(fresh, F.concat(acc, F.array(one(x["start"], x["end"], x["speaker"], x["text"])))).otherwise(grown)

    folded = ordered.select(*by, F.posexplode(F.aggregate("w", start, step)).alias("segment", "s"))
    return folded.select(*by, "segment", "s.*")


def running_admission(queue: DataFrame, by: Sequence[str], order: Sequence[str], size: str, budget: int) -> DataFrame:
    """F2 where nothing is too large: rows in order while their running sum stays within the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return queue.withColumn("promised", F.sum(size).over(w)).withColumn("admitted", F.col("promised") <= budget)


def admission(queue: DataFrame, by: Sequence[str], order: Sequence[str], key: str, size: str, budget: int, factor: float = 2.2, margin: int = 16 << 20) -> DataFrame:
    """F2 whole: too large for the budget alone: refused, the scan goes on; no room now: held, and all after it.

    What is refused doesn't enter the running sum, so windows say it too: the first row beyond the budget among the others
    ends admission for all that follow."""
    need = F.ceil(F.col(size) * factor).cast("long") + margin
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = queue.withColumn("need", need).withColumn("too_large", F.col("need") > budget)
    df = df.withColumn("promised", F.sum(F.when(~F.col("too_large"), F.col("need")).otherwise(0)).over(w))
    full = F.max(F.when(~F.col("too_large") & (F.col("promised") > budget), 1).otherwise(0)).over(w) == 1
    return df.select(*by, key, "need", F.when(full, "held").when(F.col("too_large"), "refused").otherwise("admitted").alias("verdict"))


def silent_spans(frames: DataFrame, by: Sequence[str], frame_s: float = 0.02, least_s: float = 0.3, full: float = 32768.0) -> DataFrame:
    """F8: runs of quiet frames.  frames: by, frame (number), peak.  Quiet: at most three times the tenth percentile or 1.5 % of full scale."""
    level = frames.groupBy(*by).agg(F.percentile("peak", F.lit(0.1)).alias("p10"))
    quiet = frames.join(level, list(by)).where(F.col("peak") <= F.greatest(3 * F.col("p10"), F.lit(0.015 * full)))
    run = quiet.withColumn("run", F.col("frame") - F.row_number().over(Window.partitionBy(*by).orderBy("frame")))
    df = run.groupBy(*by, "run").agg((F.min("frame") * frame_s).alias("start"), ((F.max("frame") + 1) * frame_s).alias("end"), F.count("*").alias("frames"))
    return df.where(F.col("frames") * frame_s >= least_s - 1e-9).select(*by, "start", "end")


def cuts(spans: DataFrame, by: Sequence[str], target: float) -> DataFrame:
    """cut points a stride apart, each moved to the nearest silence's middle.  spans: by, duration, silences (array of middles)."""
    n = F.greatest(F.ceil(F.col("duration") / target) - 1, F.lit(0)).cast("int")
    wish = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: k * target)
    near = lambda t: F.array_min(F.transform("silences", lambda s: F.struct(F.abs(s - t).alias("d"), s.alias("at"))))
    moved = F.transform(F.slice(wish, F.lit(1), n), lambda t: F.when(near(t)["d"] <= target / 4, near(t)["at"]).otherwise(t))
    return spans.select(*by, F.array_distinct(moved).alias("cuts"))


def plan_problems(pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """gaps over a millisecond between pieces, or an end short of the duration by more than 2 s and 2 %."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    df = pieces.withColumn("gap", F.col("start") - F.coalesce(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = df.groupBy(*by).agg(F.max("gap").alias("gap"), F.max("end").alias("end"), F.max("duration").alias("duration"))
    short = F.col("duration") - F.col("end") > F.greatest(F.lit(2.0), F.col("duration") * 0.02)
    return out.select(*by, F.when(F.col("gap") > 0.001, "gap").when(short, "short").alias("problem")).where("problem is not null")


def stitched(segments_: DataFrame, by: Sequence[str]) -> DataFrame:
    """segments of overlapping pieces without those that lie wholly within what came before."""
    w = Window.partitionBy(*by).orderBy("start", "piece", "end").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.max("end").over(w)
    return segments_.withColumn("covered", covered).where(F.col("covered").isNull() | (F.col("end") > F.col("covered"))).drop("covered")


def longest_overlap(left: Column, right: Column, most: int = 80, least: int = 1) -> Column:
    """the longest run of words that ends left and begins right."""
    limit = F.least(F.size(left), F.size(right), F.lit(most))
    fits = F.filter(F.sequence(F.lit(1), F.greatest(limit, F.lit(1))), lambda k: (k <= limit) & (F.slice(left, F.size(left) - k + 1, k) == F.slice(right, F.lit(1), k)))
    found = F.coalesce(F.array_max(fits), F.lit(0))
    return F.when((limit > 0) & (found >= least), found).otherwise(0)


def opening(lines: DataFrame, by: Sequence[str], seconds: float = 60, chars: int = 900) -> DataFrame:
    """the lines of the first minute, or where no line has a clock, those within the first 900 characters.  lines: by, line, at, text."""
    all_ = Window.partitionBy(*by)
    clocked = F.count("at").over(all_) > 0
    sofar = Window.partitionBy(*by).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    df = lines.withColumns({"_clocked": clocked, "_now": F.max("at").over(sofar), "_chars": F.sum(F.length("text") + 1).over(sofar) - F.length("text") - 1})
    return df.where(F.when(F.col("_clocked"), F.coalesce("_now", F.lit(0)) <= seconds).otherwise(F.col("_chars") < chars)).select(*lines.columns)


def first_phrase(text: Column, families: dict[str, Sequence[str]]) -> Column:
    """the family whose phrase comes first; within one, longer phrases count before their parts."""
    found = []
    for name, phrases in families.items():
        pattern = "(?i)\\b(?:" + "|".join(sorted(map(str, phrases), key=len, reverse=True)) + ")\\b"
        at = F.regexp_instr(text, F.lit(pattern))
        found.append(F.when(at > 0, F.struct(at.alias("at"), F.lit(name).alias("name"))))
    return F.array_min(F.array_compact(F.array(*found)))["name"]
