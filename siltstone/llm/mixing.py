"""Operator 9: mixing sources to target weights, with DataFrame functions alone.

Every document gets a random key, the md5 of its doc_id, so its place in its source's order is the same in every run.
The order within a source is cut into ranges of the key; the words of each range are summed, a running sum over the
ranges finds the one in which a source's budget ends, and only the documents of that range are put in order to find the
cut itself.  A source then is a few numbers and a key: no shuffle carries texts, and a source with a third of all rows
is spread over as many ranges as its size asks for.

Defined results: a null or wordless text has size 0 and takes 0; a null source is a source (the last); rows without a
doc_id are ordered by a hash of their text, rows that share one by size and hash; of rows equal in all of these at the
cut, as many as fit are taken whole, one in part and the others not, which of them is not defined (they are alike); a
source of size 0 has target 0.  Columns beside doc_id, source and text pass through untouched.  A text's words are never
held all at once but by `mixed`, which splits the one document a source that it cuts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.common import WHITE, WORD, saved, whole

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, EPOCHS = 1.5, 2.0


def words(text: str = "text") -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def random_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    none = F.concat(F.lit("null:"), F.md5(whole(text).cast("binary")))
    return F.md5(F.coalesce(F.col(doc_id).cast("string"), none))


def tie(text: str = "text") -> Column:
    return F.xxhash64(whole(text))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sizes: source, source_size, one row a source.  Adds target.

    Sources full at `epochs` times their size are, in order of that limit over their weight, the first ones: resharing
    their excess again and again ends at the one level w * x that spends the whole budget."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before, rest, all_ = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    df = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(float(epochs)))
    df = df.withColumn("per_weight", F.col("limit") / F.col("weight"))
    df = df.withColumn("budget", F.sum("source_size").over(all_) * F.lit(float(share)))
    df = df.withColumn("level", (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    df = df.withColumn("open", F.col("level") < F.col("per_weight"))
    # The level is that of the first source which stays below its limit; where none does, all are full.
    df = df.withColumn("x", F.min_by("level", F.when(F.col("open"), F.struct("per_weight", F.col("source").isNull(), "source"))).over(all_))
    return df.select("source", "source_size", F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("x"), F.col("limit"))).alias("target"))


PLACE = ("key", "doc_id", "size", "tie")  #: a document's place in its source's order


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """sized: source and PLACE.  One row a source: source_size, target, times (whole epochs), the place of the cut, and what
    the rows there take: cut_whole of them their whole size, the next one cut_words of its words."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    per = saved(per, "mix-sources")
    most = per.agg(F.max("n")).first()[0] or 0
    digits = 1  # as many ranges of a source as documents in a range, about: neither is left to one task in great number
    while 16 ** (2 * digits) < most:
        digits += 1
    goal = targets(per.select("source", "source_size"), weights, share, epochs)
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = saved(goal.withColumn("left", F.round(F.col("target")).cast("long") - F.col("times") * F.col("source_size")), "mix-goal")
    at = F.substring("key", 1, digits)
    ranges = sized.groupBy("source", at.alias("range")).agg(F.sum("size").alias("in_range"))
    order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("in_range").over(order), F.lit(0)))
    same = lambda a, b: a.eqNullSafe(b)
    hit = ranges.alias("r").join(goal.alias("g"), same(F.col("r.source"), F.col("g.source")))
    hit = hit.where("left > 0 and before < left and before + in_range >= left").select(F.col("g.source").alias("s"), "range", "before", "left")
    hit = saved(hit, "mix-ranges")
    inside = sized.alias("d").join(hit.alias("h"), same(F.col("d.source"), F.col("h.s")) & (at == F.col("h.range")))
    # Equal rows are one row here, with their number: they share a key, so no finer range would part them.
    inside = inside.groupBy("s", "before", "left", *PLACE).agg(F.count("*").alias("equal")).withColumn("all", F.col("size") * F.col("equal"))
    order = Window.partitionBy("s").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("rest", F.col("left") - F.col("before") - F.coalesce(F.sum("all").over(order), F.lit(0)))
    cut = inside.where((F.col("rest") > 0) & (F.col("all") >= F.col("rest")))
    whole_ones = F.floor((F.col("rest") - 1) / F.col("size")).cast("long")
    cut = cut.select("s", *(F.col(c).alias(f"cut_{c}") for c in PLACE), whole_ones.alias("cut_whole"), (F.col("rest") - whole_ones * F.col("size")).alias("cut_words"))
    out = goal.join(cut, same(goal.source, cut.s), "left").drop("s", "left")
    return saved(out, "mix-plan")


def _place() -> Column:
    return F.struct(*(F.col(c) for c in PLACE))


def _cut() -> Column:
    return F.struct(*(F.col(f"cut_{c}").alias(c) for c in PLACE))


def taken_in_part(rows: DataFrame, row: str) -> DataFrame:
    """rows, joined with their plan, and `part`: the words that the last, unfinished epoch takes of each.

    The rows at their source's cut, mostly one a source, are written apart with a number each; where several are equal,
    ranges of those numbers are counted and one range is put in order, so any number of them may be."""
    spark, at_cut = rows.sparkSession, F.col("cut_key").isNotNull() & _place().eqNullSafe(_cut())
    others = rows.where(~at_cut).withColumn("part", F.when(F.col("cut_key").isNotNull() & (_place() < _cut()), F.col("size")).otherwise(0).cast("long"))
    ties = saved(rows.where(at_cut).withColumn(row, F.monotonically_increasing_id()), "mix-ties")
    number = F.shiftright(row, 12)
    counted = ties.groupBy("plan_source", "cut_whole", number.alias("range")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("plan_source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    hit = counted.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).where("before <= cut_whole and cut_whole < before + n")
    hit = saved(hit.select(F.col("plan_source").alias("s"), F.col("range").alias("r"), (F.col("cut_whole") - F.col("before")).alias("nth")), "mix-tie-ranges")
    inside = ties.select("plan_source", row).join(hit, F.col("plan_source").eqNullSafe(F.col("s")) & (number == F.col("r")))
    nth = F.row_number().over(Window.partitionBy("s", "r").orderBy(row)) - 1
    last = saved(inside.withColumn("k", nth).where("k = nth").select("s", F.col(row).alias("last")), "mix-tie-last")
    part = F.when(F.col(row) < F.col("last"), F.col("size")).when(F.col(row) == F.col("last"), F.col("cut_words")).otherwise(0).cast("long")
    ties = ties.join(last, F.col("plan_source").eqNullSafe(F.col("s"))).withColumn("part", part).drop("s", "last", row)
    return others.unionByName(spark.createDataFrame([], others.schema) if ties.isEmpty() else ties)


def planned(sized: DataFrame, weights: Sequence[float], share: float, epochs: float) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and places, kept, and the plan, which Spark broadcasts in a join only if it is small."""
    measured = saved(sized.select("source", *PLACE), "mix-sizes")
    return measured, plan(measured, weights, share, epochs).withColumnRenamed("source", "plan_source")


def _sized(docs: DataFrame, *more: Column | str) -> DataFrame:
    return docs.select(*more, F.col("doc_id").cast("long").alias("doc_id"), "source", words().alias("size"), random_key().alias("key"), tie().alias("tie"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    measured, found = planned(_sized(docs), weights, share, epochs)
    df = taken_in_part(measured.join(found, measured.source.eqNullSafe(found.plan_source)), "row")
    return df.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """The mix itself, with docs' columns: whole copies, and of the document at a source's cut its first words (joined by spaces)."""
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # whatever the columns are called
    sized = _sized(docs, row, "text")
    _, found = planned(sized, weights, share, epochs)
    df = taken_in_part(sized.join(found, sized.source.eqNullSafe(found.plan_source)), "number")
    cut_text = F.array_join(F.slice(F.filter(F.split("text", WHITE + "+"), lambda x: x != ""), 1, F.greatest(F.col("part").cast("int"), F.lit(1))), " ")
    copies = F.array_repeat(F.lit(False), F.col("times").cast("int"))
    copies = F.when(F.col("part") > 0, F.concat(copies, F.array(F.col("part") < F.col("size")))).otherwise(copies)
    df = df.where("size > 0").withColumn("is_cut", F.explode(copies)).withColumn("cut_text", F.when(F.col("is_cut"), cut_text))
    new = {"text": F.col("cut_text"), "n_chars": F.length("cut_text")}
    old = {f.name: F.col("row")[f.name] for f in docs.schema}
    return df.select(*(F.when(F.col("is_cut"), new[f.name].cast(f.dataType)).otherwise(old[f.name]).alias(f.name) if f.name in new else old[f.name].alias(f.name) for f in docs.schema))


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, '')))) as key from documents),
s as (select source, sum(size) as source_size from d group by source),
w as (select *, case (row_number() over (order by source asc nulls last) - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end::double as weight from s),
l as (select *, source_size * 2.0::double as cap, source_size * 2.0::double / weight as per_weight, (sum(source_size) over ()) * 1.5::double as budget from w),
v as (select *, (budget - coalesce(sum(cap) over (order by per_weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0.0))
             / sum(weight) over (order by per_weight, source asc nulls last rows between current row and unbounded following) as level from l),
x as (select level from v where level < per_weight order by per_weight, source asc nulls last limit 1),
t as (select source, cast(source_size as bigint) as source_size, least(cap, coalesce(weight * (select level from x), cap)) as target from v),
g as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as times from t),
r as (select d.doc_id, d.size, g.source_size, g.target, g.times, cast(round(g.target) as bigint) - g.times * g.source_size as left_over,
             coalesce(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, cast(times * size + greatest(0, least(size, left_over - before)) as bigint) as taken from r
"""
