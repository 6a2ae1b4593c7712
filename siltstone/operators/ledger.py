"""Filters, lookups, aggregates and orders over the ledger: items, its append-only log, and held passages.

All take and return DataFrames.  Optional route arguments follow one rule: None means every route.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.joins import met
from siltstone.sources.adapter import ACTIVE, PIPELINE, TERMINAL

# --- folds: current state from observations and events ------------------------------------------------------------


def latest_state(log: DataFrame) -> DataFrame:
    """Last write wins per key, and how often a key was seen.  Replays fold to the same rows."""
    order = F.struct("moment", "id")
    return log.groupBy("item_id").agg(F.max_by("kind", order).alias("kind"), F.min("moment").alias("first_at"), F.max("moment").alias("last_at"), F.count("*").alias("seen_count"))


def upsert_fold(observations: DataFrame, key: str, order: Sequence[str], keep_first: Sequence[str], keep_last: Sequence[str]) -> DataFrame:
    """B2: the upsert as a fold: first non-null of some columns, last non-null of others, times seen."""
    o = F.struct(*order)
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in keep_first]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), o)).alias(c) for c in keep_last]
    return observations.groupBy(key).agg(*first, *last, F.count("*").alias("seen_count"))


def transitions(log: DataFrame) -> DataFrame:
    """State after each item's events under the rules: erased is final, done only leaves by an erasure or a requeue.

    log: item_id, id, to_state, kind.  The fold runs over one item's ordered events, so it is bounded by an item."""
    events = log.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("id", "to_state", "kind"))).alias("e"))
    ok = lambda acc, e: (acc["state"] != "ERASED") & ((acc["state"] != "DONE") | e["kind"].isin("requeued", "erased")) & e["to_state"].isNotNull()
    start = F.struct(F.lit("DISCOVERED").alias("state"), F.lit(0).cast("long").alias("refused"))
    fold = F.aggregate("e", start, lambda acc, e: F.struct(F.when(ok(acc, e), e["to_state"]).otherwise(acc["state"]).alias("state"), (acc["refused"] + F.when(ok(acc, e), 0).otherwise(1)).cast("long").alias("refused")))
    return events.select("item_id", fold.alias("f")).select("item_id", F.col("f.state").alias("state"), F.col("f.refused").alias("refused"))


def attempts(log: DataFrame) -> DataFrame:
    """Failed attempts since the last requeue."""
    reset = log.where("kind = 'requeued'").groupBy("item_id").agg(F.max("id").alias("reset_id"))
    failed = log.where("kind = 'attempt-failed'").join(reset, "item_id", "left").where("id > coalesce(reset_id, -1)")
    return failed.groupBy("item_id").agg(F.count("*").alias("attempts"))


# --- filters --------------------------------------------------------------------------------------------------------


def in_route(df: DataFrame, route: str | None) -> DataFrame:
    """C1."""
    return df if route is None else df.where(F.col("route") == route)


def by_name(items: DataFrame, needle: str, limit: int | None = None) -> DataFrame:
    """Substring of the name in any ASCII case, newest first."""
    found = items.where(F.contains(F.lower("name"), F.lit(needle.lower()))).orderBy(F.coalesce("discovered_at", F.lit("")).desc(), "item_id")
    return found.limit(limit) if limit else found


def unfinished(items: DataFrame, route: str | None = None) -> DataFrame:
    """C3, with every terminal state left out, erased ones too."""
    return in_route(items, route).where(~F.col("state").isin(*TERMINAL))


def claimable(items: DataFrame, leases: DataFrame, now: str, limit: int, route: str | None = None) -> DataFrame:
    """Active, not leased and not backed off, oldest first.  The back-off is tested before the limit is applied,
    so that a batch is never short while ready rows exist."""
    df = in_route(items, route).where(F.col("state").isin(*ACTIVE)).join(leases, "item_id", "left")
    ready = (F.col("lease_until").isNull() | (F.col("lease_until") < now)) & (F.col("retry_at").isNull() | (F.col("retry_at") <= now))
    return df.where(ready).orderBy("discovered_at", "item_id").limit(limit).select(*items.columns)


def due_for_archive(items: DataFrame, cutoff: str) -> DataFrame:
    """Done, old enough by creation or else discovery."""
    return items.where((F.col("state") == "DONE") & (F.coalesce("created_at", "discovered_at") < cutoff))


def archive_verdict(items: DataFrame, cutoff: str, disputed: DataFrame) -> DataFrame:
    """The first rule that an item fails, null for those that may move."""
    df = items.join(disputed.select("item_id").distinct().withColumn("disputed", F.lit(True)), "item_id", "left")
    reason = (
        F.when(F.col("state") == "ERASED", "erased").when(F.col("state") != "DONE", "not done").when(F.col("route").isNull(), "no route").when(F.col("disputed"), "routes disagree")
        .when(F.coalesce("created_at", "discovered_at").isNull(), "no date").when(F.coalesce("created_at", "discovered_at") >= cutoff, "too young").when(F.col("size_bytes") <= 0, "no size")
    )
    return df.select("item_id", "route", reason.alias("reason"))


def backfill_queue(items: DataFrame, cutoff: str, routes: Sequence[str]) -> DataFrame:
    """C10, C11."""
    return items.where(F.col("route").isin(*routes) & F.col("state").isin(*ACTIVE) & (F.coalesce("created_at", "discovered_at") < cutoff))


def is_waiting(items: DataFrame, cutoff: str) -> DataFrame:
    """One row, whether live work newer than the cutoff waits."""
    return items.agg(F.coalesce(F.bool_or(F.col("state").isin(*ACTIVE) & (F.coalesce("created_at", "discovered_at") >= cutoff)), F.lit(False)).alias("waiting"))


def selection(items: DataFrame, *, item_id: int | None = None, name: str | None = None, route: str | None = None, first: str | None = None, last: str | None = None) -> DataFrame:
    """All that is given must hold; dates alone select nothing by mistake, so they are refused."""
    if item_id is None and name is None and route is None:
        raise ValueError("dates alone select too much: name an item, a name or a route")
    df = in_route(items, route)
    if item_id is not None:
        df = df.where(F.col("item_id") == item_id)
    if name is not None:
        df = df.where(F.contains(F.lower("name"), F.lit(name.lower())))
    day = F.substring("discovered_at", 1, 10)
    if first:
        df = df.where(day >= first[:10])
    return df.where(day <= last[:10]) if last else df


def in_days(df: DataFrame, column: str, since: str | None, until: str | None) -> DataFrame:
    """C14: a range of days, both ends included."""
    day = F.substring(column, 1, 10)
    if since:
        df = df.where(day >= since[:10])
    return df.where(day <= until[:10]) if until else df


def review_queue(holds: DataFrame, reviewer: str, decision: str = "PENDING", limit: int | None = None) -> DataFrame:
    """One reviewer's rows only; what is pending must be armed."""
    df = holds.where((F.col("reviewer") == reviewer) & (F.col("decision") == decision))
    df = df.where("mode = 'on'") if decision == "PENDING" else df
    df = df.orderBy("held_at", "start_offset", "hold_id")
    return df.limit(limit) if limit else df


def without_words(holds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns blanked, all others kept."""
    return holds.withColumns({c: F.lit("") for c in columns})


def classify_source(df: DataFrame, outputs: DataFrame, own: DataFrame) -> DataFrame:
    """What a listed file is.  df: item_id, parent_id, is_folder, deleted, mime; outputs: parent_id; own: item_id."""
    df = df.join(own.select("item_id").distinct().withColumn("ours", F.lit(True)), "item_id", "left").join(outputs.select("parent_id").distinct().withColumn("in_output", F.lit(True)), "parent_id", "left")
    sound = F.coalesce(F.col("mime").rlike("^(audio|video)/"), F.lit(False))
    kind = F.when(F.col("is_folder") | F.col("deleted"), "STRUCTURE").when(F.col("ours"), "OUR_OUTPUT").when(F.col("in_output") & ~sound, "OUR_OUTPUT").when(sound, "RECORDING").otherwise("UNRECOGNISED")
    return df.withColumn("kind", kind)


def upload_complete(observations: DataFrame, settle_s: float = 60) -> DataFrame:
    """Ready once two successive looks at least settle_s apart agree.  observations: item_id, moment (seconds), size, ctag, hash, gone."""
    w = Window.partitionBy("item_id").orderBy("moment")
    before = {c: F.lag(c).over(w) for c in ("moment", "size", "ctag")}
    reason = (
        F.when(F.col("gone"), "deleted").when(F.coalesce("size", F.lit(0)) <= 0, "empty").when(F.col("hash").isNull(), "no hash").when(before["moment"].isNull(), "first look")
        .when(before["size"] != F.col("size"), "size changed").when(~before["ctag"].eqNullSafe(F.col("ctag")), "content changed").when(F.col("moment") - before["moment"] < settle_s, "too soon")
    )
    return observations.withColumn("reason", reason).withColumn("ready", F.col("reason").isNull())


def state_rank(state: str = "state") -> Column:
    """Place on the way to done, -1 off it."""
    return F.array_position(F.array(*map(F.lit, PIPELINE)), F.col(state)).cast("int") - 1


# --- joins ----------------------------------------------------------------------------------------------------------


def disagreements(log: DataFrame, items: DataFrame, since: str | None = None) -> DataFrame:
    """Route disagreements with what is known of their items."""
    df = log.where("route_from <> route_to")
    df = df.where(F.col("moment") >= since) if since else df
    return df.join(items.select("item_id", "route", "state"), "item_id", "left")


def dispute_after_action(log: DataFrame) -> DataFrame:
    """The newest failure after an item's last requeue."""
    act = log.where("kind = 'requeued'").groupBy("item_id").agg(F.max("id").alias("acted"))
    df = log.where("kind = 'attempt-failed'").join(act, "item_id", "left").where("id > coalesce(acted, 0)")
    return df.groupBy("item_id").agg(F.max("id").alias("dispute_id"))


def reconcile(items: DataFrame, seen: DataFrame, last_moved: DataFrame, now: str, stale_before: str, most: int) -> DataFrame:
    """What a nightly full enumeration says of each unfinished item."""
    df = unfinished(items).join(seen.select("item_id").distinct().withColumn("seen", F.lit(True)), "item_id", "left").join(last_moved, "item_id", "left")
    moved = F.coalesce("last_at", "discovered_at")
    what = F.when(F.col("seen").isNull(), "vanished").when(moved >= stale_before, "left alone").when(F.coalesce("attempts", F.lit(0)) >= most, "quarantine").otherwise("requeue")
    return df.select("item_id", "route", what.alias("disposition"))


def missing_outputs(items: DataFrame, outputs: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Done items and those of the kinds that they lack.  outputs: item_id, kind."""
    have = outputs.groupBy("item_id").agg(F.collect_set("kind").alias("have"))
    lacking = F.array_except(F.array(*map(F.lit, kinds)), F.coalesce("have", F.array().cast("array<string>")))
    return items.where("state = 'DONE'").join(have, "item_id", "left").select("item_id", F.array_join(lacking, ",").alias("missing")).where("missing <> ''")


def unswept_routes(items: DataFrame, swept: DataFrame, configured: DataFrame) -> DataFrame:
    """Routes with unfinished work that nothing swept, and whether they are still configured."""
    work = unfinished(items).groupBy("route").agg(F.count("*").alias("waiting")).join(swept.select("route"), "route", "left_anti")
    return work.join(configured.select("route").distinct().withColumn("known", F.lit(True)), "route", "left").select("route", "waiting", F.when(F.col("known"), "paused").otherwise("unwatched").alias("kind"))


def outstanding_releases(holds: DataFrame, delivered: DataFrame) -> DataFrame:
    """Released passages not yet delivered, oldest answer first."""
    return holds.where("decision = 'RELEASED'").join(delivered.select("hold_id"), "hold_id", "left_anti")


def name_owners(items: DataFrame) -> DataFrame:
    """Names that more than one item claims."""
    return items.groupBy("name").agg(F.count("*").alias("n"), F.min("item_id").alias("first_item")).where("n > 1")


def pooled_outputs(routes: DataFrame) -> DataFrame:
    """Output folders that several routes share."""
    return routes.groupBy("output").agg(F.array_join(F.sort_array(F.collect_set("route")), ",").alias("routes"), F.countDistinct("route").alias("n")).where("n > 1")


def route_loops(routes: DataFrame) -> DataFrame:
    """A route that writes where another (or itself) reads.  An equi-join on the folder."""
    a, b = routes.select(F.col("route").alias("writer"), "output"), routes.select(F.col("route").alias("reader"), F.col("source").alias("output"))
    return a.join(b, "output").select("writer", "reader", "output")


def nested_folders(routes: DataFrame, ancestors: DataFrame) -> DataFrame:
    """Routes whose folder lies within another's, as pairs of routes.  ancestors: folder, ancestor.

    The pairs grow with the square of the routes of a folder, so a folder's routes are dealt over many tasks."""
    inner = routes.join(ancestors.hint("merge"), routes.source == ancestors.folder).select(F.col("route").alias("inner_route"), "ancestor")
    outer = routes.select(F.col("route").alias("outer_route"), F.col("source").alias("ancestor"))
    return met(inner, outer, ["ancestor"]).where("inner_route <> outer_route").select("inner_route", "outer_route")


# --- aggregates -----------------------------------------------------------------------------------------------------


def cohort(items: DataFrame, per: Sequence[str] = ("day", "route")) -> DataFrame:
    """What became of a day's arrivals."""
    df = items.withColumn("day", F.substring("discovered_at", 1, 10))
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    return df.groupBy(*per).agg(F.count("*").alias("discovered"), n("DONE").alias("done"), n("QUARANTINED").alias("quarantined"), n("SKIPPED_EMPTY").alias("skipped"), F.count_if(~F.col("state").isin(*TERMINAL)).alias("in_flight"))


def state_counts(items: DataFrame) -> DataFrame:
    """By state, and by route and state, in one pass."""
    return items.groupingSets([["state"], ["route", "state"]], "state", "route").agg(F.count("*").alias("n"))


def oldest_unfinished(items: DataFrame) -> DataFrame:
    """The oldest open item, the queue's length and how many were started, of each route."""
    o = F.struct("discovered_at", "item_id")
    return unfinished(items).groupBy("route").agg(F.min_by("item_id", o).alias("item_id"), F.min("discovered_at").alias("oldest"), F.count("*").alias("queued"), F.count_if(F.col("state") != "DISCOVERED").alias("started"))


def last_advanced(log: DataFrame) -> DataFrame:
    """E3."""
    return log.where("kind = 'advanced'").groupBy("item_id").agg(F.max("moment").alias("last_at"))


def disagreement_counts(log: DataFrame) -> DataFrame:
    """Each disagreement counts for both routes."""
    return log.where("route_from <> route_to").select(F.explode(F.array("route_from", "route_to")).alias("route")).groupBy("route").agg(F.count("*").alias("n"))


def spend(calls: DataFrame, prices: DataFrame, by: Sequence[str]) -> DataFrame:
    """Tokens and cost; a model without a price makes its calls unpriced, not free."""
    df = calls.join(prices, "model", "left")
    cost = F.col("tokens") * F.col("price")
    return df.groupBy(*by).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum(cost).alias("cost"), F.count_if(F.col("price").isNull()).alias("unpriced_calls"), F.countDistinct(F.when(F.col("price").isNull(), F.col("model"))).alias("unpriced_models"))


def overview(holds: DataFrame) -> DataFrame:
    """Counts by reviewer, site, category and as a whole."""
    # The oldest moment is found as a number: a smallest string would make Spark sort instead of hash.
    holds = holds.withColumn("_at", F.unix_timestamp(F.to_timestamp("held_at")))
    agg = [F.count("*").alias("n"), F.countDistinct("item_id").alias("recordings"), F.min("_at").alias("_at"), F.grouping_id().cast("int").alias("level")]
    df = holds.groupingSets([["reviewer"], ["site"], ["category"], ["decision"], []], "reviewer", "site", "category", "decision").agg(*agg)
    return df.withColumn("oldest", F.date_format(F.timestamp_seconds("_at"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("_at")


def decisions_by_day(holds: DataFrame) -> DataFrame:
    """E12."""
    df = holds.withColumn("day", F.substring("held_at", 1, 10))
    return df.groupBy("day").agg(F.count("*").alias("held"), F.count_if(F.col("decision") == "RELEASED").alias("released"), F.count_if(F.col("decision") == "REFUSED").alias("refused"), F.count_if(F.col("decision") == "PENDING").alias("pending"), F.countDistinct("item_id").alias("recordings"))


def measurement(holds: DataFrame, passes: DataFrame) -> DataFrame:
    """What the gate held of what it read.  passes: item_id, moment, chars; only an item's newest pass counts."""
    newest = passes.groupBy("item_id").agg(F.max_by("chars", "moment").alias("chars"), F.max("moment").alias("moment"))
    read = newest.agg(F.count("*").alias("read"), F.sum("chars").alias("chars"), F.countDistinct(F.substring("moment", 1, 10)).alias("days"))
    touched = holds.agg(F.countDistinct("item_id").alias("touched"), F.count("*").alias("spans"), F.sum(F.col("end_offset") - F.col("start_offset")).alias("held_chars"))
    df = read.join(touched)  # one row each
    ratio = lambda a, b, n: F.round(F.try_divide(F.col(a).cast("double"), F.col(b)), n)
    ready = F.when(F.col("days") < 5, "too few days").when(F.col("read") < 50, "too few recordings").otherwise("enough to judge")
    return df.select("read", "touched", "spans", ratio("touched", "read", 4).alias("touched_share"), ratio("spans", "days", 2).alias("spans_per_day"), ratio("held_chars", "chars", 6).alias("text_share"), ready.alias("readiness"))


def grouped_queue(holds: DataFrame) -> DataFrame:
    """Each recording's pending passages in spoken order."""
    rows = F.sort_array(F.collect_list(F.struct("start_offset", "hold_id")))
    return holds.where("decision = 'PENDING'").groupBy("item_id").agg(F.array_join(F.transform(rows, lambda x: x["hold_id"]), ",").alias("refs"), F.count("*").alias("n"))


def held_sites(holds: DataFrame, today: str) -> DataFrame:
    """Waiting passages by site, the most first."""
    age = F.greatest(F.lit(0), F.datediff(F.lit(today).cast("date"), F.substring("held_at", 1, 10).cast("date")))
    df = holds.where("decision = 'PENDING' and mode = 'on'").groupBy("site").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("recordings"), F.max(age).alias("oldest_days"))
    return df


def queue_depth(items: DataFrame, keep: int = 14) -> DataFrame:
    """Daily depth, the newest days kept, and whether it grew since the day before and over three days."""
    daily = unfinished(items).groupBy(F.substring("discovered_at", 1, 10).alias("day")).agg(F.count("*").alias("queued"))
    newest = daily.orderBy(F.col("day").desc()).limit(keep)  # the operator keeps so many days
    w = Window.orderBy("day")
    one, two = F.lag("queued", 1).over(w), F.lag("queued", 2).over(w)
    return newest.select("day", "queued", F.coalesce(F.col("queued") > one, F.lit(False)).alias("growing"), F.coalesce((F.col("queued") > one) & (one > two), F.lit(False)).alias("growing_three_days"))


def stopped_or_queued(items: DataFrame, cutoff: str) -> DataFrame:
    """C25."""
    stopped = (F.col("state") == "QUARANTINED") | F.col("discovered_at").isNull() | (F.col("discovered_at") < cutoff)
    return items.where(~F.col("state").isin("DONE", "SKIPPED_EMPTY", "ERASED")).groupBy("route").agg(F.count_if(stopped).alias("stopped"), F.count_if(~stopped).alias("queued"))


def route_digest(configured: DataFrame, items: DataFrame) -> DataFrame:
    """Configured routes and those that only the ledger knows."""
    have = items.groupBy("route").agg(F.count("*").alias("n"), F.count_if(~F.col("state").isin(*TERMINAL)).alias("open"))
    return configured.select("route").distinct().withColumn("configured", F.lit(True)).join(have, "route", "full_outer").select("route", F.coalesce("configured", F.lit(False)).alias("configured"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"))


def projected_month(spent: Column, day_of_month: Column) -> Column:
    """E8."""
    return spent / day_of_month * 30


def interleave(items: DataFrame, limit: int, slice_size: int = 1, start: int = 0) -> DataFrame:
    """Rows of each route, oldest first, taken slice by slice in turn from the start-th route on.

    A turn is a rank in a route divided by the slice, so no loop is needed; ranks past the limit can't be picked, and Spark
    drops them before the shuffle's sort (a group limit)."""
    own = Window.partitionBy("route").orderBy("discovered_at", "item_id")
    ranked = items.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= limit)
    names = items.select("route").distinct()
    index = names.withColumn("i", F.row_number().over(Window.orderBy("route")) - 1).withColumn("n", F.count("*").over(Window.partitionBy()))  # a row a route
    df = ranked.join(index, "route")
    turn = F.floor((F.col("rn") - 1) / slice_size)
    place = (F.col("i") - start % F.col("n") + F.col("n")) % F.col("n")
    return df.orderBy(turn, place, "rn").limit(limit).select(*items.columns)
