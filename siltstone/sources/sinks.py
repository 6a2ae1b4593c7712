"""Sinks that can be run again: batches keyed by name, staged publishing with read-back, envelopes, status files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

ENVELOPE = ("item_id", "kind", "title", "body", "occurred_at", "author", "site", "route", "source_name", "version")


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
    return hadoop.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop.Path  # noqa: SLF001


def cursor_folder(spark: SparkSession, path: str, route: str) -> str:
    """The name under which the running stream's cursor writes: the checkpoint's own id after a number that grows.

    Batch numbers begin anew with each checkpoint (another source folder, a resync), so they name a batch only together with
    it.  The id lies in the checkpoint and survives restarts: a replay finds its folder again.  Outside a stream: one cursor."""
    own = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    if own is None:
        return "00000000"
    fs, at = _fs(spark, path)
    home = at(f"{path.rstrip('/')}/route={route}")
    have = [x.getPath().getName().removeprefix("cursor=") for x in fs.listStatus(home)] if fs.exists(home) else []
    mine = [x for x in have if x.endswith(own)]
    return min(mine) if mine else f"{1 + max((int(x[:8]) for x in have if x[:8].isdigit()), default=0):08d}-{own}"


def append_batch(df: DataFrame, path: str, route: str, batch_id: int) -> None:
    """One micro-batch of a route's cursor; a replay of it overwrites its own folder, so rows never come twice, and
    no other cursor's batch of the same number is touched."""
    cursor = cursor_folder(df.sparkSession, path, route)
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/route={route}/cursor={cursor}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of all batches with route, cursor and batch; cursors order as strings in the order in which they began."""
    return spark.read.schema(f"{schema}, route string, cursor string, batch long").parquet(path)


def publish(files: DataFrame, path: str, expected: int = 3) -> None:
    """Files (name, data) of one item appear together or not at all.

    They are written beside the target, read back and compared by digest, then the folder gets its name; on any difference
    what was staged is removed."""
    spark, stage = files.sparkSession, f"{path.rstrip('/')}.staged"
    fs, at = _fs(spark, path)
    if fs.exists(at(path)):
        return
    digest = lambda df: df.select("name", F.sha2(F.col("data").cast("binary"), 256).alias("d"))
    try:
        files.select("name", "data").coalesce(1).write.mode("overwrite").parquet(stage)
        back = spark.read.schema("name string, data string").parquet(stage)
        n, differ = back.count(), digest(files).exceptAll(digest(back)).limit(1).count()
        if n != expected or differ:
            raise ValueError(f"read back {n} of {expected} files" if n != expected else "a file read back differs")
        if not fs.rename(at(stage), at(path)):
            raise OSError(f"could not name {path}")
    finally:
        if fs.exists(at(stage)):
            fs.delete(at(stage), True)


def release_once(files: DataFrame, path: str) -> int:
    """Released passages (item_id, ref, name, data) appended where no file of that item and ref is yet; how many were new.

    One writer at a time: what is there is read first, so a replay after a failure writes only what is missing."""
    spark = files.sparkSession
    fs, at = _fs(spark, path)
    new = files.dropDuplicates(["item_id", "ref"]).select("item_id", "ref", "name", "data")
    if fs.exists(at(path)):
        new = new.join(spark.read.schema(new.schema).parquet(path).select("item_id", "ref"), ["item_id", "ref"], "left_anti")
    new = new.observe(seen := Observation(), F.count("*").alias("n"))
    new.write.mode("append").parquet(path)
    return seen.get["n"]


def envelopes(df: DataFrame) -> DataFrame:
    """A JSON document a row, of exactly the agreed fields."""
    if set(df.columns) != set(ENVELOPE):
        raise ValueError(f"fields differ: {sorted(set(df.columns) ^ set(ENVELOPE))}")
    return df.select(F.to_json(F.struct(*ENVELOPE)).alias("value"))


def write_status(df: DataFrame, path: str) -> None:
    """Counts, stamps and one name; a text column other than those is refused."""
    allowed = {"instance", "day", "written_at", "version"}
    prose = [c for c, t in df.dtypes if t == "string" and c not in allowed]
    if prose:
        raise ValueError(f"columns may hold prose: {prose}")
    df.coalesce(1).write.mode("overwrite").json(path)


def rendered(df: DataFrame) -> DataFrame:
    """Transcript, summary and actions of each row as (item_id, name, data).

    df: item_id, stem, subject, at (timestamp), body, summary (array of strings), actions (array of struct owner, what)."""
    head = F.concat_ws("\n", F.concat(F.lit("subject: "), "subject"), F.concat(F.lit("date: "), F.date_format("at", "yyyy-MM-dd HH:mm:ss xxx")))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    said = F.transform("actions", lambda a: F.concat(a["owner"], F.lit(" is reported as saying they would "), a["what"]))
    files = F.array(
        F.struct(F.concat("stem", F.lit(".md")).alias("name"), F.concat_ws("\n\n", head, "body").alias("data")),
        F.struct(F.concat(F.lit("_"), "stem", F.lit("-summary.md")).alias("name"), F.concat_ws("\n\n", head, listed(F.col("summary"))).alias("data")),
        F.struct(F.concat(F.lit("_"), "stem", F.lit("-actions.md")).alias("name"), F.concat_ws("\n\n", head, listed(said)).alias("data")),
    )
    return df.select("item_id", F.explode(files).alias("f")).select("item_id", "f.*")
