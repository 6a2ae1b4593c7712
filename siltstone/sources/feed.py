"""The change feed: pages of items as JSON files, flattened; a folder listing; ancestry; status files; site books.

A feed page is one JSON document with `items`, `cursor` and `is_final`.  As a stream, each file is at most one
micro-batch, and the checkpoint is the cursor: it moves only once a batch has been handled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltstone.sources.sinks import _fs

#: What Spark says of a checkpoint that it can't go on from.
EXPIRED = re.compile(r"(?i)checkpoint|offset|OFFSET_LOG|incomplete log|malformed log|metadata")

ITEM = "id string, name string, size long, eTag string, cTag string, file struct<mimeType:string,hashes:struct<sha256Hash:string,quickXorHash:string,sha1Hash:string>>, folder struct<childCount:int>, package struct<type:string>, deleted struct<state:string>, pendingOperations struct<pendingContentUpdate:struct<queuedDateTime:string>>, parentReference struct<id:string>, createdDateTime string, lastModifiedDateTime string, webUrl string"
PAGE = f"items array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ITEM.split(', '))}>>, cursor string, is_final boolean"


def flattened(pages: DataFrame) -> DataFrame:
    """A4, A5: a row an item; of several hashes the strongest one."""
    i = F.col("item")
    hashes = i["file"]["hashes"]
    return pages.select(F.explode("items").alias("item"), "cursor").select(
        i["id"].alias("item_id"), i["name"].alias("name"), i["size"].alias("size"), i["parentReference"]["id"].alias("parent_id"), i["cTag"].alias("ctag"),
        F.coalesce(hashes["sha256Hash"], hashes["quickXorHash"], hashes["sha1Hash"]).alias("hash"), i["file"]["mimeType"].alias("mime"), i["folder"].isNotNull().alias("is_folder"),
        i["deleted"].isNotNull().alias("deleted"), i["pendingOperations"].isNotNull().alias("pending"), i["createdDateTime"].alias("created_at"), i["lastModifiedDateTime"].alias("modified_at"), F.col("cursor").alias("page_cursor"),
    )


def scan(spark: SparkSession, path: str) -> DataFrame:
    """The whole feed from its beginning, as one batch."""
    return flattened(spark.read.schema(PAGE).option("multiLine", "true").json(path))


def stream(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A1: the feed as it grows."""
    return flattened(spark.readStream.schema(PAGE).option("multiLine", "true").option("maxFilesPerTrigger", files_a_batch).json(path))


def wanted(items: DataFrame, own: DataFrame) -> DataFrame:
    """Neither folders, nor items without an id, nor this service's own outputs."""
    return items.where("item_id is not null and not is_folder").join(own.select("item_id"), "item_id", "left_anti")


def checkpoint_of(base: str, route: str, source_id: str, name: str = "delta", resyncs: int = 0) -> str:
    """A cursor belongs to a folder; another folder, or a resync, begins at another checkpoint.  What either has
    written stays: batches are named by their checkpoint (sinks.cursor_folder)."""
    import hashlib

    return f"{base.rstrip('/')}/{name}/{route}/{hashlib.sha256(source_id.encode()).hexdigest()[:16]}" + (f"-{resyncs}" if resyncs else "")


class Cursors:
    """Where each route's cursor is.  A reset only ever goes back, to the beginning, and says why."""

    def __init__(self, spark: SparkSession, base: str, name: str = "delta"):
        self.spark, self.base, self.name = spark, base.rstrip("/"), name

    def _resets(self, route: str, source_id: str) -> list[str]:
        fs, at = _fs(self.spark, self.base)
        home = at(checkpoint_of(self.base, route, source_id, self.name) + "-resets")
        return sorted(x.getPath().getName() for x in fs.listStatus(home)) if fs.exists(home) else []

    def of(self, route: str, source_id: str) -> str:
        return checkpoint_of(self.base, route, source_id, self.name, len(self._resets(route, source_id)))

    def reset(self, route: str, source_id: str, reason: str) -> str:
        """The checkpoint from which the route is read anew.  The mark is a folder that can be made only once, so of two
        resets at one time there is one."""
        if not reason.strip():
            raise ValueError("a reset needs a reason")
        n = len(self._resets(route, source_id)) + 1
        fs, at = _fs(self.spark, self.base)
        mark = at(checkpoint_of(self.base, route, source_id, self.name) + f"-resets/{n:06d}")
        out = fs.create(mark, False)
        out.write(bytearray(reason.encode()))
        out.close()
        return self.of(route, source_id)

    def reasons(self, route: str, source_id: str) -> list[str]:
        home = checkpoint_of(self.base, route, source_id, self.name) + "-resets"
        names = self._resets(route, source_id)
        rows = self.spark.read.option("wholetext", "true").text([f"{home}/{n}" for n in names]).select("value", F.input_file_name().alias("f")).orderBy("f").collect() if names else []
        return [r.value for r in rows]  # a row a reset


def poll(spark: SparkSession, sources: dict[str, DataFrame], handle, checkpoints: dict[str, str], expired=None) -> dict[str, str]:  # noqa: ANN001
    """One pass over every route; a route that fails does not stop the others.  Returns what went wrong by route.

    expired(route, reason): called where a cursor is of no use any more (its checkpoint can't be read, A2); the checkpoint
    that it returns is then tried once, from the beginning."""
    wrong: dict[str, str] = {}

    def start(route: str) -> StreamingQuery:
        return sources[route].writeStream.foreachBatch(lambda batch, n, route=route: handle(batch, n, route)).option("checkpointLocation", checkpoints[route]).trigger(availableNow=True).start()

    def outcome(route: str, query: StreamingQuery | None) -> str | None:
        try:
            (query or start(route)).awaitTermination()
        except Exception as e:  # noqa: BLE001  each route's failure is its own result
            return str(e).splitlines()[0] or type(e).__name__
        return None

    running: dict[str, StreamingQuery | None] = {}
    for route in sources:
        try:
            running[route] = start(route)
        except Exception:  # noqa: BLE001  tried again below, where its failure is recorded
            running[route] = None
    for route, query in running.items():
        said = outcome(route, query)
        if said and expired and EXPIRED.search(said):
            checkpoints = checkpoints | {route: expired(route, said)}
            said = outcome(route, None)
        if said:
            wrong[route] = said
    return wrong


def ancestors(folders: DataFrame, most: int = 32) -> DataFrame:
    """Folder, ancestor, depth of each folder's way up, by doubling: each round joins ways of equal length.

    folders: folder, parent.  Five rounds reach 32 levels; a cycle ends with them."""
    ways = folders.where("parent is not null").select("folder", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    reach = 1
    while reach < most:
        a, b = ways.alias("a"), ways.alias("b")
        longer = a.join(b, F.col("a.ancestor") == F.col("b.folder")).where(F.col("a.depth") == reach).select("a.folder", "b.ancestor", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        ways = ways.unionByName(longer)
        reach *= 2
    return ways.where(F.col("depth") <= most).groupBy("folder", "ancestor").agg(F.min("depth").alias("depth"))


STATUS = "instance string, day string, written_at string, version string, arrived int, done int, failed int, queued int, in_flight int, held int, overdue int, unpriced boolean, month_usd double, day_usd double"


def statuses(spark: SparkSession, path: str, now: str) -> DataFrame:
    """The peers' status files with their age in hours; a file that can't be read is skipped."""
    df = spark.read.schema(STATUS).option("mode", "DROPMALFORMED").option("multiLine", "true").json(path).where("instance is not null")
    age = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.try_to_timestamp("written_at"))) / 3600
    return df.withColumn("hours_old", age).withColumn("silent", age.isNull() | (age > 36)).orderBy(F.lower("instance"))


BOOK = "vocab_contract int, generated_at string, sites map<string,struct<title:string,status_raw:string,contractors_raw:string,client_org_raw:string,supervisor_raw:string,timeline_raw:string,owners_raw:string,monday_item_id:string>>"


def site_book(spark: SparkSession, path: str, contract: int = 1) -> DataFrame:
    """Site, title and the rest of a book of the expected contract; anything else gives no rows."""
    df = spark.read.schema(BOOK).option("multiLine", "true").option("mode", "PERMISSIVE").json(path).where(F.col("vocab_contract") == contract)
    return df.select(F.explode("sites").alias("site", "s")).select("site", "s.*")


def small_files(spark: SparkSession, path: str, most: int = 1 << 20) -> DataFrame:
    """Files up to a size, whole."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") <= most)


def directory_size(spark: SparkSession, path: str) -> DataFrame:
    """Files and bytes below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
