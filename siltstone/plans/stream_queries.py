"""Queries over streams and state: each stream runs until its input is used up, into the shared folder, and is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import ledger as L
from siltstone.plans.registry import Registry
from siltstone.session import new_path, on_executors, table
from siltstone.sources.adapter import KINDS, LOG, iso, log
from siltstone.sources.sinks import append_batch, read_batches
from siltstone.streaming import ingest as I

R = Registry()


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return on_executors(spark).readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def to_end(df: DataFrame, path: str, mode: str = "append", cursors: int = 1) -> DataFrame:
    """Runs a stream over all that is there, once for each cursor.  Complete results replace each other, others are kept by
    cursor and batch."""
    spark, schema = df.sparkSession, df.schema

    def keep(batch: DataFrame, n: int) -> None:
        append_batch(batch, path, "all", 0 if mode == "complete" else n)

    for k in range(cursors):
        df.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}-state-{k}").trigger(availableNow=True).start().awaitTermination()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return read_batches(spark, path, ddl).select(*schema.names)


def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    return event_stream(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), iso("ts").alias("moment"), kind.alias("kind"))


@R("select strftime(ts, '%Y-%m-%d') as day, event_type as kind, count(*) as n from events group by 1, 2")
def stream_day_cohorts(spark, d):
    events = event_stream(spark, d).select("ts", F.col("event_type").alias("kind"))
    return to_end(I.cohorts(events), new_path(spark, "stream-cohorts"), "complete")


@R(f"with {LOG} select item_id, arg_max(kind, (moment, id)) as kind, min(moment) as first_at, max(moment) as last_at, count(*) as seen_count from log group by item_id")
def stream_ingest_fold(spark, d):
    """The log as it comes in, appended batch by batch and folded to the items' state."""
    return L.latest_state(to_end(log_stream(spark, d), new_path(spark, "stream-log")))


@R(f"with {LOG} select item_id, arg_max(kind, (moment, id)) as kind, min(moment) as first_at, max(moment) as last_at, 2 * count(*) as seen_count from log group by item_id")
def stream_resync_fold(spark, d):
    """The same log read twice, the second time from another cursor as after a resync: nothing of the first is overwritten."""
    return L.latest_state(to_end(log_stream(spark, d), new_path(spark, "stream-resync"), cursors=2))


def requests_of(df: DataFrame) -> DataFrame:
    """Events as requests for leases: who asks is the value's last digit."""
    verb = F.when(F.col("event_type") == "view", "claim").when(F.col("event_type") == "click", "renew").when(F.col("event_type") == "signup", "release").when(F.col("event_type") == "error", "fail").otherwise("claim")
    who = F.concat(F.lit("w"), F.floor("value").cast("long") % 2)
    return df.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seq"), (F.expr("unix_micros(cast(ts as timestamp)) / 1000000")).alias("at"), who.alias("owner"), verb.alias("verb"), F.lit(14400.0).alias("lease_s"))


@R()
def lease_claims(spark, d):
    return I.leases(requests_of(table(spark, d, "events")))


@R()
def stream_lease_claims(spark, d):
    return to_end(I.leases(requests_of(event_stream(spark, d))), new_path(spark, "stream-leases"))


@R(f"with {LOG} select id, item_id, kind, case when item_id % 10 <> 0 then meta end as meta, case when item_id % 10 <> 0 then route_from end as route_from from log")
def erased_log(spark, d):
    rows = log(spark, d)
    return I.erased(rows, rows.where("item_id % 10 = 0"), ("meta", "route_from")).select("id", "item_id", "kind", "meta", "route_from")


SEEN = "seen as (select l_suppkey as item_id, l_linenumber as start, l_linenumber + 5 as \"end\", l_returnflag as text, strftime(l_shipdate, '%Y-%m-%d') as a, case when l_linestatus = 'O' and l_partkey % 50 = 0 then 'on' else 'shadow' end as mode from lineitem)"


@R(f"""with {SEEN} select left(sha256(concat_ws('␟', item_id, start, "end", text)), 16) as hold_id, item_id, min(a) as held_at, count(*) as times_seen, case when bool_or(mode = 'on') then 'on' else 'shadow' end as mode from seen group by item_id, start, "end", text""")
def holds_once(spark, d):
    n = F.col("l_linenumber")
    on = (F.col("l_linestatus") == "O") & (F.col("l_partkey") % 50 == 0)
    seen = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("item_id"), n.alias("start"), (n + 5).alias("end"), F.col("l_returnflag").alias("text"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.when(on, "on").otherwise("shadow").alias("mode"))
    return I.held_once(seen, armed=False).select("hold_id", "item_id", "held_at", "times_seen", "mode")


@R("""with a as (select user_id as hold_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as t, event_type as decision, case when value > 5 then 'p' || (event_id % 3) end as who, event_id % 4 = 0 as supersede, event_id % 9 = 0 as undone from events),
    r as (select *, row_number() over (partition by hold_id order by t, decision) as n from a where who is not null and not undone) select hold_id, arg_max(decision, (t, n)) as decision, arg_max(who, (t, n)) as "by", max(t) as moment from r where n = 1 or supersede group by 1""")
def decisions(spark, d):
    k = F.col("event_id")
    a = table(spark, d, "events").select(F.col("user_id").alias("hold_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.col("event_type").alias("decision"), F.when(F.col("value") > 5, F.concat(F.lit("p"), k % 3)).alias("by"), (k % 4 == 0).alias("supersede"), (k % 9 == 0).alias("undone"))
    return I.decided(a).withColumnRenamed("at", "moment")


@R("""with t as (select o_custkey as reviewer, o_orderkey as selector, strftime(o_orderdate, '%Y-%m-%d') as issued_at, strftime(o_orderdate + interval 400 day, '%Y-%m-%d') as expires_at, o_orderstatus = 'P' as revoked from orders),
    n as (select *, row_number() over (partition by reviewer order by issued_at desc, selector desc) as n from t) select reviewer, selector, expires_at from n where n = 1 and expires_at > '2001-06-01' and not revoked""")
def live_tokens(spark, d):
    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("reviewer"), F.col("o_orderkey").alias("selector"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_at"), F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 400), "yyyy-MM-dd").alias("expires_at"), (F.col("o_orderstatus") == "P").alias("revoked"))
    return I.live_tokens(t, "2001-06-01")


@R("""with m as (select c_custkey as job, c_custkey % 24 as hour, case when c_custkey % 5 = 0 then 'month' else 'day' end as period, case when c_custkey % 3 = 0 then '2024-03-10' when c_custkey % 3 = 1 then '2024-03-09' end as last_done, case when c_custkey % 7 = 0 then timestamp '2024-03-10 11:50:00' end as last_tried from customer)
    select job from m where 12 >= hour and not coalesce(case when period = 'month' then left(last_done, 7) = '2024-03' else last_done = '2024-03-10' end, false) and not coalesce(last_tried > timestamp '2024-03-10 11:30:00', false)""")
def due_jobs(spark, d):
    k = F.col("c_custkey")
    m = table(spark, d, "customer").select(k.alias("job"), (k % 24).alias("hour"), F.when(k % 5 == 0, "month").otherwise("day").alias("period"), F.when(k % 3 == 0, "2024-03-10").when(k % 3 == 1, "2024-03-09").alias("last_done"), F.when(k % 7 == 0, "2024-03-10 11:50:00").alias("last_tried"))
    return I.due_jobs(m, "2024-03-10 12:00:00")
