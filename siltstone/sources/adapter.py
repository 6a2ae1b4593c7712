"""The Parquet tables of a folder as the tables that the operators work on.

The mapping is this library's own: orders stand for items (a route is a priority, a state a status), events for the
log, documents for transcripts, conversations for spoken segments, benchmark passages for held words, lineitem ship
dates per supplier for time spans, parts for sites, and part prices for model prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import table

PIPELINE = ("DISCOVERED", "CLAIMED", "FETCHED", "TRANSCRIBED", "ANALYSED", "DONE")
TERMINAL = ("DONE", "QUARANTINED", "SKIPPED_EMPTY", "ERASED")
ACTIVE = PIPELINE[:-1]
#: event kinds of the log, by the events table's types
KINDS = {"view": "claimed", "click": "advanced", "signup": "discovered", "error": "attempt-failed", "purchase": "requeued"}


def iso(ts: str) -> F.Column:
    """ISO 8601 with seconds and Z; the tables' timestamps have no zone and count as UTC."""
    return F.date_format(F.col(ts).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, name, route, state, discovered_at, created_at, size_bytes, owner."""
    df = table(spark, sf_dir, "orders")
    r = F.col("o_orderkey") % 7
    state = F.when(F.col("o_orderstatus") == "F", F.when(r == 0, "QUARANTINED").when(r == 1, "SKIPPED_EMPTY").otherwise("DONE"))
    state = state.when(F.col("o_orderstatus") == "O", F.when(r < 3, "DISCOVERED").otherwise("FETCHED")).otherwise(F.when(r < 2, "CLAIMED").when(r == 2, "ERASED").otherwise("ANALYSED"))
    name = F.concat(F.lit("Call +27"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("_"), F.date_format("o_orderdate", "yyMMdd"), F.lit("_"), F.lpad((F.col("o_orderkey") % 240000).cast("string"), 6, "0"), F.when(F.col("o_orderkey") % 5 == 0, " (2).m4a").otherwise(".m4a"))
    return df.select(
        F.col("o_orderkey").alias("item_id"), name.alias("name"), F.col("o_orderpriority").alias("route"), state.alias("state"), iso("o_orderdate").alias("discovered_at"),
        F.when(F.col("o_orderkey") % 3 != 0, iso("o_orderdate")).alias("created_at"), F.floor(F.col("o_totalprice")).cast("long").alias("size_bytes"), F.col("o_custkey").alias("owner"),
    )


#: The same in SQL, for the queries' counterparts.
ITEMS = """items as (
  select o_orderkey as item_id, 'Call +27' || lpad(cast(o_custkey as varchar), 9, '0') || '_' || strftime(o_orderdate, '%y%m%d') || '_' || lpad(cast(o_orderkey % 240000 as varchar), 6, '0')
         || case when o_orderkey % 5 = 0 then ' (2).m4a' else '.m4a' end as name, o_orderpriority as route,
         case when o_orderstatus = 'F' then case when o_orderkey % 7 = 0 then 'QUARANTINED' when o_orderkey % 7 = 1 then 'SKIPPED_EMPTY' else 'DONE' end
              when o_orderstatus = 'O' then case when o_orderkey % 7 < 3 then 'DISCOVERED' else 'FETCHED' end
              else case when o_orderkey % 7 < 2 then 'CLAIMED' when o_orderkey % 7 = 2 then 'ERASED' else 'ANALYSED' end end as state,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') as discovered_at,
         case when o_orderkey % 3 <> 0 then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as created_at,
         cast(floor(o_totalprice) as bigint) as size_bytes, o_custkey as owner from orders)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, item_id, moment, kind, route_from, route_to, value, meta: the append-only log."""
    df = table(spark, sf_dir, "events")
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("event_type"))
    k = F.get_json_object("props", "$.k").cast("int")
    return df.select(F.col("event_id").alias("id"), F.col("user_id").alias("item_id"), iso("ts").alias("moment"), kind.alias("kind"), F.concat(F.lit("r"), k % 5).alias("route_from"), F.concat(F.lit("r"), k % 3).alias("route_to"), "value", F.col("props").alias("meta"))


LOG = """log as (
  select event_id as id, user_id as item_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as moment,
         case event_type when 'view' then 'claimed' when 'click' then 'advanced' when 'signup' then 'discovered' when 'error' then 'attempt-failed' when 'purchase' then 'requeued' end as kind,
         'r' || (cast(json_extract(props, '$.k') as int) % 5) as route_from, 'r' || (cast(json_extract(props, '$.k') as int) % 3) as route_to, value, props as meta from events)"""


def holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """hold_id, item_id, reviewer, category, decision, mode, site, held_at, answered_at, start, end: passages held for a person."""
    df = table(spark, sf_dir, "lineitem")
    n = F.col("l_orderkey") + F.col("l_linenumber")
    pick = lambda k, *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return df.select(
        F.substring(F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), 256), 1, 16).alias("hold_id"), F.col("l_orderkey").alias("item_id"),
        F.when(F.col("l_suppkey") % 10 != 0, F.concat(F.lit("rev"), F.col("l_suppkey") % 6)).alias("reviewer"), pick(F.col("l_partkey"), "commercial", "staff_matter", "legal_exposure", "bare_identifier", "do_not_write_down", "personal").alias("category"),
        F.when(F.col("l_returnflag") == "A", "RELEASED").when(F.col("l_returnflag") == "R", "REFUSED").otherwise("PENDING").alias("decision"), F.when(F.col("l_linestatus") == "O", "on").otherwise("shadow").alias("mode"),
        F.concat(F.lit("site-"), F.col("l_partkey") % 40).alias("site"), iso("l_shipdate").alias("held_at"), F.when(F.col("l_returnflag") != "N", iso("l_shipdate")).alias("answered_at"),
        (F.floor("l_extendedprice") % 5000).cast("long").alias("start_offset"), (F.floor("l_extendedprice") % 5000 + F.floor("l_quantity")).cast("long").alias("end_offset"), n.alias("n"),
    )


HOLDS = """holds as (
  select left(sha256(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 16) as hold_id, l_orderkey as item_id,
         case when l_suppkey % 10 <> 0 then 'rev' || (l_suppkey % 6) end as reviewer,
         ['commercial', 'staff_matter', 'legal_exposure', 'bare_identifier', 'do_not_write_down', 'personal'][l_partkey % 6 + 1] as category,
         case l_returnflag when 'A' then 'RELEASED' when 'R' then 'REFUSED' else 'PENDING' end as decision, case when l_linestatus = 'O' then 'on' else 'shadow' end as mode,
         'site-' || (l_partkey % 40) as site, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') as held_at, case when l_returnflag <> 'N' then strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') end as answered_at,
         cast(floor(l_extendedprice) as bigint) % 5000 as start_offset, cast(floor(l_extendedprice) as bigint) % 5000 + cast(floor(l_quantity) as bigint) as end_offset, l_orderkey + l_linenumber as n from lineitem)"""


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, pos, speaker, start, end, text: the segments' words, 0.3 s each, with a pause of 1.2 s after a full stop."""
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return df
