"""The ingest as streams: feed pages to an append-only log, leases and retries as state, erasure, schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.sources.sinks import append_batch


def ingest(feed: DataFrame, path: str, route: str, checkpoint: str, own: DataFrame | None = None, **trigger):  # noqa: ANN003, ANN201
    """Every page of a route's feed into the log.  The cursor (checkpoint) follows the rows, never leads them."""

    def handle(batch: DataFrame, n: int) -> None:
        kept = batch.where("item_id is not null and not is_folder")
        kept = kept.join(own.select("item_id"), "item_id", "left_anti") if own is not None else kept
        append_batch(kept.drop("route"), path, route, n)

    return feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def current(observations: DataFrame) -> DataFrame:
    """B2: the items as they are now.  A deletion is remembered by its first sight and never undone; an erased item stays erased."""
    o = F.struct("cursor", "batch", F.coalesce("modified_at", F.lit("")))
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in ("name", "size", "hash", "mime", "ctag", "parent_id", "created_at")]
    return observations.groupBy("item_id", "route").agg(*last, F.min(F.when(F.col("deleted"), F.struct("cursor", "batch")))["batch"].alias("deleted_in"), F.count("*").alias("seen_count"))


def changes(observations: DataFrame) -> DataFrame:
    """B2's events: content of an item that changed between two looks."""
    w = Window.partitionBy("item_id").orderBy("cursor", "batch", "modified_at")
    before = F.lag("hash").over(w)
    return observations.withColumn("before", before).where("before is not null and hash is not null and before <> hash").select("item_id", "cursor", "batch", "before", "hash")


LEASE_STATE = "owner string, until double, attempts long, retry_at double, done boolean"
LEASE_OUT = "item_id long, at double, owner string, verb string, granted boolean, attempts long"


def _leases(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Claims, renewals, releases, failures and completions of one item, in order of time.

    A claim succeeds if the item is neither done, nor leased past its moment, nor waiting for a retry; only an owner with a
    live lease renews, releases, fails or completes.  A failure waits twice as long as the one before it; after the fifth
    the item counts as done (quarantined)."""
    owner, until, attempts, retry, done = state.get if state.exists else (None, 0.0, 0, 0.0, False)
    out = []
    rows = pd.concat(list(frames)).sort_values(["at", "seq"])
    for r in rows.itertuples():
        ok = False
        mine = owner == r.owner and r.at < until
        if r.verb == "claim" and not done and r.at >= until and r.at >= retry:
            owner, until, ok = r.owner, r.at + r.lease_s, True
        elif r.verb == "renew" and mine:
            until, ok = r.at + r.lease_s, True
        elif r.verb == "release" and mine:
            owner, until, ok = None, 0.0, True
        elif r.verb == "fail" and mine:
            attempts += 1
            owner, until, retry, ok, done = None, 0.0, r.at + min(3600.0, 30.0 * 2 ** (attempts - 1)), True, attempts >= 5
        elif r.verb == "complete" and mine:
            owner, until, ok, done = None, 0.0, True, True
        elif r.verb == "requeue":
            attempts, retry, ok, done = 0, 0.0, True, False
        out.append((key[0], r.at, r.owner, r.verb, ok, attempts))
    state.update((owner, float(until), int(attempts), float(retry), bool(done)))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in LEASE_OUT.split(", ")])


def leases(requests: DataFrame) -> DataFrame:
    """requests: item_id, seq, at (seconds), owner, verb, lease_s.  One writer a key: what a compare-and-swap would give.

    A batch DataFrame is folded from an empty state by the same function."""
    if requests.isStreaming:
        return requests.groupBy("item_id").applyInPandasWithState(_leases, LEASE_OUT, LEASE_STATE, "append", GroupStateTimeout.NoTimeout)

    class Memory:
        exists, get = False, None

        def update(self, _: tuple) -> None: ...

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return next(_leases(key, iter([pdf]), Memory()))

    return requests.groupBy("item_id").applyInPandas(run, LEASE_OUT)


def erased(log: DataFrame, requests: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The log with the contents of erased items gone and everything else kept; running it again changes nothing."""
    df = log.join(requests.select("item_id").distinct().withColumn("_erased", F.lit(True)), "item_id", "left")
    return df.withColumns({c: F.when(F.col("_erased").isNull(), F.col(c)) for c in columns}).drop("_erased")


def held_once(spans: DataFrame, armed: bool) -> DataFrame:
    """One row a passage however often it is found; a shadow passage found again while the gate is armed is pending."""
    key = F.substring(F.sha2(F.concat_ws("␟", "item_id", "start", "end", "text"), 256), 1, 16)
    df = spans.withColumn("hold_id", key).groupBy("hold_id", "item_id", "start", "end", "text").agg(F.min("at").alias("held_at"), F.count("*").alias("times_seen"), F.bool_or(F.col("mode") == "on").alias("_on"))
    return df.withColumn("mode", F.when(F.col("_on") | F.lit(armed), "on").otherwise("shadow")).drop("_on")


def decided(answers: DataFrame) -> DataFrame:
    """The decision of each hold: the first answer, and later ones only if they say they supersede it; an
    answer taken back within its window does not count.  answers: hold_id, at, decision, by, supersede, undone."""
    w = Window.partitionBy("hold_id").orderBy("at", "decision")
    counted = answers.where("by is not null and by <> '' and not undone").withColumn("n", F.row_number().over(w)).where("n = 1 or supersede")
    return counted.groupBy("hold_id").agg(F.max_by("decision", F.struct("at", "n")).alias("decision"), F.max_by("by", F.struct("at", "n")).alias("by"), F.max("at").alias("at"))


def live_tokens(tokens: DataFrame, now: str) -> DataFrame:
    """Each reviewer's newest token, unless it is revoked or has run out."""
    newest = tokens.groupBy("reviewer").agg(F.max_by(F.struct("selector", "expires_at", "revoked"), F.struct("issued_at", "selector")).alias("t"))
    return newest.select("reviewer", "t.*").where((F.col("expires_at") > now) & ~F.col("revoked")).drop("revoked")


def due_jobs(marks: DataFrame, now: str, retry_s: int = 1800) -> DataFrame:
    """Jobs whose local hour has come and that have not run in this period, nor been tried just now.

    marks: job, hour, period (day or month), last_done, last_tried (local times)."""
    t = F.lit(now).cast("timestamp_ntz")
    fmt = F.when(F.col("period") == "month", F.date_format(t, "yyyy-MM")).otherwise(F.date_format(t, "yyyy-MM-dd"))
    done = F.when(F.col("period") == "month", F.substring("last_done", 1, 7)).otherwise(F.substring("last_done", 1, 10))
    tried = F.col("last_tried").isNotNull() & (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col("last_tried").cast("timestamp")) < retry_s)
    return marks.where((F.hour(t) >= F.col("hour")) & ~F.coalesce(done == fmt, F.lit(False)) & ~tried).select("job")


def cohorts(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Day cohorts of a stream of events (ts, kind); late rows within the delay still count."""
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def sql_functions(spark: SparkSession) -> None:
    """K2: the Python functions by their SQL names."""
    from siltstone.functions import matching
    from siltstone.sources.media import SplitPieces

    for name in ("normalise", "verify_quote", "locate_spans", "redact_text", "mask_text", "quick_xor_hash"):
        spark.udf.register(name, getattr(matching, name))
    spark.udtf.register("split_pieces", SplitPieces)
