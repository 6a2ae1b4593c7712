"""What the operators of this folder share: tables, the folder that all executors see, linked components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import new_path as new_path
from siltstone.session import removed
from siltstone.session import table as table

#: ASCII white space, and a word: the same class in Java's, Python's and RE2's regular expressions.
WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again: it cuts the lineage, and a lost executor costs no more than its tasks.

    What is written stays until the application ends, as the result may be read at any time until then."""
    return _saved(df, name)[0]


def _saved(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: str = "text") -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(text), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    while name in df.columns:
        name += "_"
    return name


HUB = 50_000  #: rows of one node that a join may send to one task


def _beside(rows: DataFrame, least: DataFrame, n: int, most: int = HUB) -> DataFrame:
    """rows (u, v) beside the m of their u.  least: u, m, c (how many of the rows are u's, at least); n: rows, at most.

    A node with over K = max(most, n / 1000) rows is a hub: there are at most 1,000 of them, a broadcast of known size, and
    their rows stay where they are.  All others meet by a shuffle in which no node has more than K rows."""
    k = max(most, n // 1000)
    if n <= k:
        return rows.join(least.drop("c"), "u")
    hubs = F.broadcast(least.where(F.col("c") > k).drop("c"))
    return rows.join(hubs, "u").unionByName(rows.join(hubs.select("u"), "u", "left_anti").join(least.where(F.col("c") <= k).drop("c"), "u"))


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60, most: int = HUB) -> DataFrame:
    """Smallest id reachable from each id that has a link, by alternating large-star and small-star rounds.

    edges: columns a, b (long); self-links, repeats and either direction are allowed.  Returns id, component.
    Each round is two aggregations with partial sums and two joins on the id, hubs apart (_beside); its result is written
    to the shared folder and that of the round before deleted, so neither lineage, nor disk, nor driver memory grows.  Ends
    when a round changes nothing: in practice within about log2 of the longest chain; that it takes no more than max_rounds
    is not proved, and a graph that did would be an error, not a wrong result."""
    spark = edges.sparkSession
    now, path = _saved(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    last = mark(now)
    for _ in range(max_rounds):
        if not last[0]:
            break
        # Large star: every larger neighbour of u is tied to the smallest of u and its neighbours.
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        large, large_path = _saved(_beside(both, least, 2 * last[0], most).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        ties = _beside(large, least, 2 * last[0], most).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now, new_path_ = _saved(ties.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), name)
        removed(spark, path, large_path)
        path, new = new_path_, mark(now)
        if new == last:
            break
        last = new
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
