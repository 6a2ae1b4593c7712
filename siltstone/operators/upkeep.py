"""Upkeep of the ledger and of what surrounds it: patches, moves, clearing, selections, expiry, rates, peers.

All take and return DataFrames and keep no state; a replayed patch or move folds to the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import display_name
from siltstone.operators.ledger import unfinished

#: What only discovery, transitions and moves between routes may change.
PROTECTED = ("item_id", "state", "discovered_at", "route")


def _stated(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) != ""


# --- changes ----------------------------------------------------------------------------------------------------------


def patched(items: DataFrame, patches: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sparse patches (item_id, id, columns; null is unchanged), the newest value of each column.

    Erased items stay as they are.  Unknown and protected columns raise; patches of unknown items are in orphans()."""
    if wrong := [c for c in columns if c in PROTECTED or c not in items.columns]:
        raise ValueError(f"not writable as fields: {wrong}")
    newest = patches.groupBy("item_id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"_new_{c}") for c in columns))
    new = lambda c: F.when(F.col("state") == "ERASED", F.col(c)).otherwise(F.coalesce(f"_new_{c}", c)).alias(c)
    return items.join(newest, "item_id", "left").select(*(new(c) if c in columns else c for c in items.columns))


def orphans(changes: DataFrame, items: DataFrame) -> DataFrame:
    """Patches or moves of items that the ledger doesn't have."""
    return changes.join(items.select("item_id"), "item_id", "left_anti")


def rerouted(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves (item_id, id, route, reason): the newest with a reason decides; erased items stay."""
    newest = moves.where(_stated("route") & _stated("reason")).groupBy("item_id").agg(F.max_by("route", "id").alias("_route"))
    route = F.when(F.col("state") == "ERASED", F.col("route")).otherwise(F.coalesce("_route", "route"))
    return items.join(newest, "item_id", "left").withColumn("route", route).select(*items.columns)


def clearable(scratch: DataFrame, items: DataFrame, running: DataFrame, now: Column, keep_s: float = 48 * 3600) -> DataFrame:
    """Scratch files (item_id, path, bytes, modified in seconds) of items neither unfinished nor running, past the time that they are kept."""
    busy = unfinished(items).select("item_id").union(running.select("item_id"))
    return scratch.where(now - F.col("modified") > keep_s).join(busy, "item_id", "left_anti")


def reach(items: DataFrame, outputs: DataFrame, holds: DataFrame) -> DataFrame:
    """H6: what erasing each item would reach: its outputs (item_id, name) and the number of its held passages."""
    names = outputs.where(_stated("name")).groupBy("item_id").agg(F.sort_array(F.collect_set("name")).alias("outputs"))
    held = holds.groupBy("item_id").agg(F.count("*").alias("held"))
    df = items.where("state <> 'ERASED'").join(names, "item_id", "left").join(held, "item_id", "left")
    return df.select("item_id", "name", "route", "state", F.coalesce("created_at", "discovered_at").alias("recorded_at"), F.coalesce("outputs", F.array().cast("array<string>")).alias("outputs"), F.coalesce("held", F.lit(0)).alias("held"))


def deliveries(holds: DataFrame, transcripts: DataFrame, delivered: DataFrame) -> DataFrame:
    """What is to be done about each answered or open passage, and the file that a release is written to.

    transcripts: item_id, transcript; delivered: hold_id.  Writing goes through sinks.release_once, so a replay writes nothing."""
    done = delivered.select("hold_id").distinct().withColumn("_there", F.lit(True))
    df = holds.join(transcripts.select("item_id", "transcript"), "item_id", "left").join(done, "hold_id", "left")
    what = (
        F.when(F.col("mode") == "shadow", "nothing was withheld").when(F.col("decision") == "REFUSED", "refused").when(F.col("decision") != "RELEASED", "not answered")
        .when(F.col("_there"), "already there").when(F.col("transcript").isNull(), "no transcript").otherwise("to write")
    )
    ref = F.upper(F.substring("hold_id", 1, 6))
    name = F.when(what.isin("to write", "already there"), F.concat(F.regexp_replace("transcript", r"\.[^.]*$", ""), F.lit("-released-"), ref, F.lit(".md")))
    return df.select("hold_id", "item_id", ref.alias("ref"), what.alias("what"), name.alias("file"))


# --- lookups and selections -------------------------------------------------------------------------------------------


def by_ref(holds: DataFrame, ref: str) -> DataFrame:
    """Every passage with a short reference, the earliest first; references can collide, and then all are shown."""
    return holds.where(F.upper(F.substring("hold_id", 1, 6)) == ref.strip().upper()).orderBy("held_at", "hold_id")


def history(log: DataFrame, key: str, value: object, limit: int = 100) -> DataFrame:
    """The first events of one item or passage, by id."""
    return log.where(F.col(key) == value).orderBy("id").limit(limit)


def selected_routes(routes: DataFrame, asked: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """H3: the routes to act on, and what is wrong with what was asked.  routes: route, enabled; asked: route.

    Nothing asked means all that are on.  A name that is unknown or switched off is a problem, not an empty selection."""
    on = F.coalesce("enabled", F.lit(True))
    if asked is None:
        none = routes.agg(F.count_if(on).alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("route"), F.lit("no route is on").alias("problem"))
        return routes.where(on), none
    wanted = asked.select(F.trim("route").alias("route")).distinct()
    known = routes.select("route", on.alias("_on"))
    problem = F.when(F.col("_on").isNull(), "unknown").when(~F.col("_on"), "switched off")
    return routes.where(on).join(wanted, "route", "left_semi"), wanted.join(known, "route", "left").select("route", problem.alias("problem")).where("problem is not null")


def reviewers_meant(typed: DataFrame, holds: DataFrame, decision: str = "PENDING") -> DataFrame:
    """Who, reviewer, candidates: the reviewer whom a typed name means among those with such passages.

    A name as filed wins; else the one whose name without its domain is the same in any case.  Several are candidates and no
    reviewer; none leaves the name as typed.  Reviewers are as many as people, so the join is on a small distinct set."""
    person = lambda c: F.lower(F.trim(display_name(F.trim(c))))
    known = holds.where((F.col("decision") == decision) & _stated("reviewer") & (F.col("reviewer") != "unassigned")).select("reviewer").distinct()
    who = typed.select("who").distinct().where(_stated("who"))
    exact = who.join(known, F.trim("who") == F.col("reviewer"), "left_semi").select("who", F.trim("who").alias("reviewer"), F.lit(None).cast("string").alias("candidates"))
    met = who.join(exact, "who", "left_anti").withColumn("_p", person(F.col("who"))).join(known.withColumn("_p", person(F.col("reviewer"))), "_p", "left")
    near = met.groupBy("who").agg(F.sort_array(F.collect_set("reviewer")).alias("c"))
    meant = F.when(F.size("c") == 0, F.trim("who")).when(F.size("c") == 1, F.get("c", F.lit(0)))
    return exact.unionByName(near.select("who", meant.alias("reviewer"), F.when(F.size("c") > 1, F.array_join("c", ", ")).alias("candidates")))


NAMING = "naming struct<decided boolean, name string, reason string>"


def named_on(items: DataFrame, day: str, route: str | None = None) -> DataFrame:
    """E5: decided names of the items that finished on a day.  items: item_id, name, route, done_at, meta (JSON)."""
    df = items.where(F.startswith("done_at", F.lit(day)))
    df = df if route is None else df.where(F.col("route") == route)
    df = df.withColumn("n", F.from_json("meta", NAMING)["naming"]).where("n.decided")
    return df.select("item_id", F.col("name").alias("source_name"), "route", "done_at", F.col("n.name").alias("named"), F.col("n.reason").alias("reason"))


# --- reports ----------------------------------------------------------------------------------------------------------


def expiries(dates: DataFrame, today: str, notice_days: int = 45) -> DataFrame:
    """Credentials (what, until) that have run out or soon will; a date that can't be read counts as today's."""
    raw = F.trim("until")
    day = F.try_to_timestamp(F.substring(raw, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    left = F.coalesce(F.datediff(day, F.lit(today).cast("date")), F.lit(0))
    said = F.when(day.isNull(), "unreadable").when(left < 0, "expired").when(left <= notice_days, "expires")
    return dates.where(_stated("until")).select("what", left.alias("days"), said.alias("said")).where("said is not null").orderBy("days", "what")


def queue_state(items: DataFrame, mornings: DataFrame, day: str, now: str, stale_s: float = 24 * 3600) -> DataFrame:
    """One row: what is queued, how old the oldest is, and whether the queue falls behind.  mornings: day, queued, as kept by E18."""
    moment = F.unix_timestamp(F.to_timestamp("discovered_at"))
    q = unfinished(items).agg(F.count("*").alias("queued"), F.count_if(F.col("state") != "DISCOVERED").alias("started"), F.min(moment).alias("_oldest"))
    two = mornings.where(F.col("day") < day).orderBy(F.col("day").desc()).limit(2)  # the two mornings that are asked about
    before = two.agg(F.max_by("queued", "day").alias("previous"), F.when(F.count("*") == 2, F.min_by("queued", "day")).alias("_earlier"))
    age = F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.col("_oldest")
    some = F.col("queued") > 0
    df = q.join(before)  # one row each
    df = df.withColumns({
        "oldest_age_s": age, "stale": some & F.coalesce(age > stale_s, F.lit(False)), "growing": some & F.coalesce(F.col("queued") > F.col("previous"), F.lit(False)),
        "growing_across_days": F.coalesce((F.col("queued") > F.col("previous")) & (F.col("previous") > F.col("_earlier")), F.lit(False)),
    })
    return df.withColumn("short_of_throughput", some & (F.col("stale") | F.col("growing_across_days"))).drop("_oldest", "_earlier")


def group_totals(peers: DataFrame, silent_hours: float = 36) -> DataFrame:
    """Totals over the copies of the service; one that is undated or long silent is counted as such."""
    quiet = F.col("hours_old").isNull() | (F.col("hours_old") > silent_hours)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return peers.agg(F.count("*").alias("peers"), F.count_if(quiet).alias("silent"), *(total(c).alias(c) for c in ("arrived", "done", "failed", "month_usd", "day_usd")), F.coalesce(F.bool_or("unpriced"), F.lit(False)).alias("any_unpriced"))


# --- rates ------------------------------------------------------------------------------------------------------------


def paced(calls: DataFrame, by: Sequence[str], per_minute: float, burst: int) -> DataFrame:
    """When each call (at, seconds; id breaks ties) may start under a token bucket that is full at first, first come first served.

    A bucket is the same as a theoretical arrival time that each call pushes on by one gap from itself or from the call,
    whichever is later.  That recurrence is a running maximum of at - rank * gap, so a window says it without a fold."""
    gap = 60.0 / per_minute
    own = Window.partitionBy(*by).orderBy("at", "id")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    df = calls.withColumn("_i", F.row_number().over(own) - 1).withColumn("_level", F.col("at") - F.col("_i") * gap)
    free = F.max("_level").over(before) + F.col("_i") * gap - (burst - 1) * gap
    return df.withColumn("starts", F.greatest(F.col("at").cast("double"), free)).drop("_i", "_level")
