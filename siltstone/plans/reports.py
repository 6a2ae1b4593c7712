"""The daily report: small aggregates, gathered and written out as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.report import subject
from siltstone.operators import ledger as L


def day_figures(items: DataFrame, day: str) -> DataFrame:
    """One row a route of a day's arrivals, with its subject line."""
    df = L.cohort(items.where(F.col("discovered_at").startswith(day)), ["route"])
    return df.withColumn("subject", subject(F.lit(day), F.col("discovered"), F.col("done"), F.col("quarantined"), F.col("in_flight")))


def daily_report(items: DataFrame, holds: DataFrame, day: str) -> str:
    """What arrived, what waits and what is held, a line a route and site.  What is gathered has a row each of those."""
    lines = [f"Report of {day}", ""]
    lines += [r.subject + f" ({r.route})" for r in day_figures(items, day).orderBy("route").collect()] or ["nothing arrived"]
    waiting = L.oldest_unfinished(items).orderBy("route").collect()
    lines += ["", "Waiting:"] + [f"  {r.route}: {r.queued}, {r.started} begun, the oldest since {r.oldest[:10]}" for r in waiting]
    held = L.held_sites(holds, day).orderBy(F.col("n").desc(), F.col("oldest_days").desc(), "site").collect()
    lines += ["", "Held for a person:"] + [f"  {r.site}: {r.n} in {r.recordings} recordings, up to {r.oldest_days} days" for r in held]
    return "\n".join(lines) + "\n"
