"""Operator 1: token ids as Parquet list columns that can be read selectively.

Layout: files in ascending doc_id order, one per range partition.  `ids` is a list column in dictionary encoding (a
vocabulary fits one dictionary page); doc_id, part, local_start and n_tokens are delta-packed (writer version 2, no
dictionary), so metadata reads touch a few bytes a row.  Row groups and pages have set sizes and Parquet's column and
offset indexes are written, so a range of doc_id reads the row groups and pages that hold it and no others.

Defined results: a null text counts as empty; every document ends with end_id, so an empty one has one token; rows with
one doc_id stay side by side, ordered by the text's first 32 characters and then a hash of it; a null doc_id comes first.  Columns beside doc_id and text are not read,
so clashing names do no harm.  An empty table gives an empty one.  A text and its ids are held in memory while it is
encoded and written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.bpe import encoder
from siltstone.llm.common import new_path, partitions

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, files: int | None = None, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10, page_rows: int = 2_000) -> None:
    """Encodes docs (doc_id, text) and writes the token files to path."""
    from pyspark import TaskContext

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            doc_ids, texts = batch.column("doc_id"), batch.column("text")
            for lo in range(0, len(batch), 256):  # bounds what is held beside the batch itself
                some = [enc.encode(t) + end for t in texts.slice(lo, 256).to_pylist()]
                n = np.fromiter((len(x) // 4 for x in some), np.int64, len(some))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(some), "<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), part, np.int32)), doc_ids.slice(lo, 256), pa.array(starts), pa.array(n), ids], ["part", "doc_id", "local_start", "n_tokens", "ids"])

    n = files or partitions(docs.sparkSession)
    # Rows that share a doc_id (or have none) may be very many: ranges part them by the first letters and a hash of the text,
    # and equal rows by their number.  These keys are short, as a sample of them reaches the driver.
    keys = [F.col("doc_id"), F.substring("text", 1, 32), F.xxhash64("text"), F.col("number")]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("number"))
    ordered = docs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    writer = ordered.mapInArrow(encode, SCHEMA).write.option("compression", "zstd").option("parquet.writer.version", "PARQUET_2_0")
    for k, v in {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.page.row.count.limit": page_rows, "parquet.dictionary.page.size": 1 << 20, "parquet.enable.dictionary": "true", **{f"parquet.enable.dictionary#{c}": "false" for c in ("part", "doc_id", "local_start", "n_tokens")}}.items():
        writer = writer.option(k, str(v))
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "ids"), first: int | None = None, last: int | None = None) -> DataFrame:
    """The columns asked for of the documents first..last: both are pushed down to the scan."""
    df = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        df = df.where(F.col("doc_id") >= first)
    if last is not None:
        df = df.where(F.col("doc_id") <= last)
    return df.select(*columns)


def offsets(spark: SparkSession, path: str) -> DataFrame:
    """part, base: ids in the files before each file, from the metadata columns alone.  One row a file."""
    totals = read_tokens(spark, path, ("part", "n_tokens")).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("ids")
        at = ids.offsets.to_numpy().astype(np.int64) * 4
        raw = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4").view(np.uint8))
        crc = pa.array([zlib.crc32(raw[at[i] : at[i + 1]]) for i in range(len(ids))], pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "doc_id", "local_start", "n_tokens")), crc], ["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def token_digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the token files and reads them back: doc_id, start, n_tokens, ids_crc32.

    The table of file offsets that is broadcast has one row a file, which is as many as the write had partitions."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    back = spark.read.schema(SCHEMA).parquet(path).mapInArrow(checksums, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return back.join(F.broadcast(offsets(spark, path)), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
