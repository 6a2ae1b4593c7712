"""Queries with sequential semantics: sessions, intervals, admission, overlaps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from siltstone.operators import windows as W
from siltstone.plans.registry import Registry
from siltstone.session import table
from siltstone.sources.adapter import ITEMS, items

R = Registry()

SPANS = "spans as (select l_suppkey as k, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) as start, date_diff('day', date '1992-01-01', cast(l_shipdate as date)) + cast(floor(l_quantity / 10) as int) as \"end\" from lineitem)"


def spans(spark, d):
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), day.alias("start"), (day + F.floor(F.col("l_quantity") / 10).cast("int")).alias("end"))


ISLANDS = """m as (select *, max("end") over (partition by k order by start, "end" rows between unbounded preceding and 1 preceding) as b from {}), f as (select *, case when b is null or start > b then 1 else 0 end as f from m),
    g as (select *, sum(f) over (partition by k order by start, "end" rows unbounded preceding) as g from f)"""


@R(f'with {SPANS}, {ISLANDS.format("spans")} select k, min(start) as start, max("end") as "end", count(*) as n from g group by k, g')
def interval_union(spark, d):
    return W.islands(spans(spark, d), ["k"], "start", "end").select("k", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "n")


@R("""with l as (select c_custkey % 40 as k, (c_custkey * 37) % 1000 as start, (c_custkey * 37) % 1000 + 5 + c_custkey % 60 as "end" from customer), h as (select s_suppkey % 40 as k, (s_suppkey * 53) % 1000 as start, (s_suppkey * 53) % 1000 + 40 as "end" from supplier),
    p as (select k, unnest(range(start, "end")) as x from l), free as (select distinct k, x from p where not exists (select 1 from h where h.k = p.k and p.x >= h.start and p.x < h."end")), r as (select k, x, x - row_number() over (partition by k order by x) as g from free)
    select k, min(x) as start, max(x) + 1 as "end" from r group by k, g having count(*) >= 3""")
def interval_difference(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    labelled = table(spark, d, "customer").select((c % 40).alias("k"), (c * 37 % 1000).alias("start"), (c * 37 % 1000 + 5 + c % 60).alias("end"))
    held = table(spark, d, "supplier").select((s % 40).alias("k"), (s * 53 % 1000).alias("start"), (s * 53 % 1000 + 40).alias("end"))
    return W.subtract(labelled, held, ["k"])


@R("""with l as (select c_custkey as id, c_custkey % 40 as k, (c_custkey * 37) % 1000 as start, (c_custkey * 37) % 1000 + 30 as "end" from customer), h as (select s_suppkey % 40 as k, (s_suppkey * 53) % 1000 as s2, (s_suppkey * 53) % 1000 + 40 as e2 from supplier)
    select l.k, id, start, "end", s2 as other_start, e2 as other_end from l join h on l.k = h.k and start < e2 and s2 < "end" """)
def interval_overlaps(spark, d):
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    a = table(spark, d, "customer").select(c.alias("id"), (c % 40).alias("k"), (c * 37 % 1000).alias("start"), (c * 37 % 1000 + 30).alias("end"))
    b = table(spark, d, "supplier").select((s % 40).alias("k"), (s * 53 % 1000).alias("start"), (s * 53 % 1000 + 40).alias("end"))
    return W.overlaps(a, b, ["k"])


@R("""with w as (select user_id as k, epoch_us(ts) / 1000000 as start, epoch_us(ts) / 1000000 + value as "end", event_type as speaker from events), f as (select *, case when lag("end") over x is null or lag(speaker) over x is distinct from speaker or start - lag("end") over x > 3600 then 1 else 0 end as n from w window x as (partition by k order by start, "end")),
    g as (select *, sum(n) over (partition by k order by start, "end" rows unbounded preceding) as session from f) select k, cast(session as bigint) as session, round(min(start), 3) as start, round(max("end"), 3) as "end", min(speaker) as speaker, count(*) as words from g group by 1, 2""")
def gap_sessions(spark, d):
    t = F.expr("unix_micros(cast(ts as timestamp)) / 1000000")
    w = table(spark, d, "events").select(F.col("user_id").alias("k"), t.alias("start"), (t + F.col("value")).alias("end"), F.col("event_type").alias("speaker"), F.lit("w").alias("text"))
    s = W.sessions(w, ["k"], 3600)
    return s.select("k", "session", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "speaker", F.size(F.split("text", " ")).cast("long").alias("words"))


@R()
def word_segments(spark, d):
    """Words of each turn, 0.3 s apiece and 1.2 s of silence after a full stop, as segments of at most about 320 characters."""
    df = table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), F.posexplode(F.split("text", r"\s+")).alias("pos", "text"))
    stop = F.sum(F.when(F.col("text").endswith("."), 1).otherwise(0)).over(Window.partitionBy("conv_id", "turn").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    at = F.col("pos") * 0.3 + F.coalesce(stop, F.lit(0)) * 1.2
    return W.segments(df.select("conv_id", "turn", at.alias("start"), (at + 0.3).alias("end"), "speaker", "text"), ["conv_id", "turn"])


@R(f"with {ITEMS} select item_id, route, cast(sum(size_bytes) over w as bigint) as promised, sum(size_bytes) over w <= 50000000 as admitted from items window w as (partition by route order by discovered_at, item_id rows unbounded preceding)")
def running_budget_admission(spark, d):
    return W.running_admission(items(spark, d), ["route"], ["discovered_at", "item_id"], "size_bytes", 50_000_000).select("item_id", "route", "promised", "admitted")


@R(f"""with {ITEMS}, n as (select *, cast(ceil(size_bytes * 1000 * 2.2::double) as bigint) + 16777216 as need from items), t as (select *, need > 1000000000 as big from n), p as (select *, sum(case when big then 0 else need end) over (partition by route order by discovered_at, item_id rows unbounded preceding) as promised from t),
    f as (select *, max(case when not big and promised > 1000000000 then 1 else 0 end) over (partition by route order by discovered_at, item_id rows unbounded preceding) as full_ from p)
    select route, item_id, need, case when full_ = 1 then 'held' when big then 'refused' else 'admitted' end as verdict from f""")
def admission_with_refusals(spark, d):
    df = items(spark, d).withColumn("size_bytes", F.col("size_bytes") * 1000)
    return W.admission(df, ["route"], ["discovered_at", "item_id"], "item_id", "size_bytes", 1_000_000_000)


FRAMES = "frames as (select user_id as k, row_number() over (partition by user_id order by event_id) - 1 as frame, case when value < 45 then floor(value) else 20000.0 end as peak from events)"


@R(f"""with {FRAMES}, l as (select k, quantile_cont(peak, 0.1) as p10 from frames group by 1), q as (select k, frame from frames join l using (k) where peak <= greatest(3 * p10, 0.015 * 32768)), r as (select *, frame - row_number() over (partition by k order by frame) as g from q)
    select k, round(min(frame) * 0.02, 6) as start, round((max(frame) + 1) * 0.02, 6) as "end" from r group by k, g having count(*) * 0.02 >= 0.3 - 1e-9""")
def silent_spans(spark, d):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = table(spark, d, "events").select(F.col("user_id").alias("k"), n.alias("frame"), F.when(F.col("value") < 45, F.floor("value").cast("double")).otherwise(20000.0).alias("peak"))
    return W.silent_spans(frames, ["k"]).select("k", F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@R()
def cut_points(spark, d):
    df = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") / 100).alias("duration"), F.array(*[(F.col("o_totalprice") / 100 * x).alias("s") for x in (0.21, 0.48, 0.77)]).alias("silences"))
    return W.cuts(df, ["k"], 600.0).select("k", F.transform("cuts", lambda x: F.round(x, 3)).alias("cuts"))


@R("""with p as (select l_orderkey as k, l_linenumber * 10.0 as start, l_linenumber * 10.0 + 10 + case when l_quantity > 25 then 0.5 else -0.5 end as "end", 70.0 as duration from lineitem where l_linenumber > 0), b as (select *, start - coalesce(max("end") over (partition by k order by start, "end" rows between unbounded preceding and 1 preceding), 0.0) as gap from p),
    a as (select k, max(gap) as gap, max("end") as e, max(duration) as du from b group by 1) select k, case when gap > 0.001 then 'gap' when du - e > greatest(2.0, du * 0.02) then 'short' end as problem from a where gap > 0.001 or du - e > greatest(2.0, du * 0.02)""")
def split_plan_problems(spark, d):
    n = F.col("l_linenumber") * 10.0
    p = table(spark, d, "lineitem").where("l_linenumber > 0").select(F.col("l_orderkey").alias("k"), n.alias("start"), (n + 10 + F.when(F.col("l_quantity") > 25, 0.5).otherwise(-0.5)).alias("end"), F.lit(70.0).alias("duration"))
    return W.plan_problems(p, ["k"])


@R("""with s as (select l_suppkey as k, l_linenumber as piece, l_orderkey as id, (l_orderkey * 7) % 100000 as start, (l_orderkey * 7) % 100000 + cast(floor(l_quantity) as bigint) as "end" from lineitem), c as (select *, max("end") over (partition by k order by start, piece, "end" rows between unbounded preceding and 1 preceding) as c from s)
    select k, count(*) as kept, cast(sum(start) as bigint) as total from c where c is null or "end" > c group by 1""")
def stitched_segments(spark, d):
    o = F.col("l_orderkey") * 7 % 100000
    s = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("piece"), F.col("l_orderkey").alias("id"), o.alias("start"), (o + F.floor("l_quantity")).alias("end"))
    return W.stitched(s, ["k"]).groupBy("k").agg(F.count("*").alias("kept"), F.sum("start").alias("total"))


@R("""with x as (select c_custkey as k, [(c_custkey + i) % 4 for i in range(12)] as l, [(c_custkey * 3 + i) % 4 for i in range(9)] as r from customer) select k, coalesce(list_max([n for n in range(1, 10) if l[13 - n:12] = r[1:n]]), 0) as n from x""")
def longest_word_overlap(spark, d):
    k = F.col("c_custkey")
    left, right = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: (k + i) % 4), F.transform(F.sequence(F.lit(0), F.lit(8)), lambda i: (k * 3 + i) % 4)
    df = table(spark, d, "customer").select(k.alias("k"), left.alias("l"), right.alias("r"))
    return df.select("k", W.longest_overlap(F.col("l"), F.col("r")).cast("long").alias("n"))


@R("""with l as (select conv_id as k, turn as line, text, cast(sum(length(text) + 1) over (partition by conv_id order by turn rows unbounded preceding) - length(text) - 1 as bigint) as before from conversations) select k, line, length(text) as chars from l where before < 900""")
def opening_lines(spark, d):
    df = table(spark, d, "conversations").select(F.col("conv_id").alias("k"), F.col("turn").alias("line"), F.lit(None).cast("double").alias("at"), "text")
    return W.opening(df, ["k"]).select("k", "line", F.length("text").cast("long").alias("chars"))


@R()
def first_phrases(spark, d):
    families = {"english": ["the", "and the"], "german": ["der", "die", "und"], "romance": ["que", "de la", "les"]}
    return table(spark, d, "documents").select("doc_id", W.first_phrase(F.col("text"), families).alias("family"))
