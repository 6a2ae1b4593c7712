"""Operator 10: token-count rollups kept up to date by deltas.

A batch of changes (inserts, deletes, revised counts) becomes signed deltas of documents and tokens by source, language
and tokenizer version, summed before they are shuffled.  Totals are the sum of the deltas of all committed batches.

A batch is committed by its name, once.  Each attempt writes its deltas to a folder of its own, then creates the batch's
marker, which fails if it exists and which names that folder: of two writers one wins, and neither touches what the other
has written.  A batch whose marker exists is not run again, so a replay changes nothing, and deltas that no marker names
are not read.  compact() folds the batches of one listing into a base that says which they are; batches that come meanwhile
are in no base.  The markers stay, so a batch that was folded can't come again.

Counts are of the tokenizers library's ids, through the operators' common encoder (bpe.py).

Defined results: null sources, languages or versions are groups of their own; a null count counts as 0; a change of
another kind than the three is an error; groups whose documents and tokens have both come to 0 are left out; an empty table
gives no rows.  `maintained` reads doc_id, text, source and lang alone, counts a null text as empty, and counts equal texts
once, for the smallest doc_id (null before all; rows that share the smallest doc_id too all count); a text is held whole
while it is encoded.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.bpe import encoder
from siltstone.llm.common import new_path, saved, whole

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """changes: kind (insert, delete, revise), source, lang, tokenizer, n_tokens, old_tokens (of a revision), and copies, if
    a row may stand for several equal changes."""
    copies = F.coalesce(F.col("copies"), F.lit(1)) if "copies" in changes.columns else F.lit(1)
    n, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    kind = F.col("kind")
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(F.raise_error(F.concat(F.lit("unknown change "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == "insert", n).when(kind == "delete", -n).otherwise(n - old)
    return changes.groupBy(*KEYS).agg(F.sum((docs * copies).cast("long")).alias("n_docs"), F.sum((tokens * copies).cast("long")).alias("n_tokens"))


class Rollups:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, (path or new_path(spark, "rollups")).rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs  # noqa: SLF001
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001

    def _at(self, *names: str):  # noqa: ANN202
        return self._hadoop.Path("/".join((self.path, *names)))

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _known(self, batch: str) -> bool:
        return bool(self._fs.exists(self._at("committed", batch)))

    def _mark(self, folder: str, name: str, says: str = "") -> bool:
        """Whether the marker is ours: it can be made once."""
        try:
            out = self._fs.create(self._at(folder, name), False)
        except Exception as e:  # a Java exception; anything but "it exists" is passed on
            if self._fs.exists(self._at(folder, name)):
                return False
            raise e from None
        out.write(bytearray(says.encode()))
        out.close()
        return True

    def committed(self) -> dict[str, str]:
        """The committed batches and where the deltas of each are.  Two numbers and a name a batch reach the driver."""
        names = self._names("committed")
        if not names:
            return {}
        rows = self.spark.read.option("wholetext", "true").text([f"{self.path}/committed/{n}" for n in names]).select("value").collect()
        return dict(r.value.split(" ") for r in rows)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new."""
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9.-]*", batch):
            raise ValueError(f"not a batch name: {batch!r}")
        if self._known(batch):
            return False
        attempt = f"deltas/{batch}/{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.path}/{attempt}")
        return self._mark("committed", batch, f"{batch} {attempt}")

    def _folded(self) -> tuple[str | None, set[str]]:
        """The newest finished base, and the batches that it holds."""
        done = self._names("bases")
        if not done:
            return None, set()
        folder = self.spark.read.option("wholetext", "true").text(f"{self.path}/bases/{done[-1]}").first().value
        held = self.spark.read.schema("batch string").parquet(f"{self.path}/{folder}/batches")
        return f"{folder}/totals", {r.batch for r in held.collect()}  # names of batches

    def _sum(self, base: str | None, folders: list[str]) -> DataFrame:
        paths = [f"{self.path}/{f}" for f in folders] + ([f"{self.path}/{base}"] if base else [])
        found = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return found.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def totals(self) -> DataFrame:
        batches = self.committed()  # before the base: a base that is finished meanwhile holds no more than its own listing
        base, held = self._folded()
        return self._sum(base, [f for b, f in batches.items() if b not in held])

    def compact(self) -> None:
        """One listing of batches decides both what is summed and what the base says it holds."""
        base, held = self._folded()
        batches = self.committed()
        number, folder = len(self._names("bases")), f"base/{uuid.uuid4().hex}"
        self._sum(base, [f for b, f in batches.items() if b not in held]).write.parquet(f"{self.path}/{folder}/totals")
        self.spark.createDataFrame([(b,) for b in held | set(batches)], "batch string").write.parquet(f"{self.path}/{folder}/batches")
        self._mark("bases", f"{number:09d}", folder)  # of two that fold at once the first stays, the other's work is not read


#: Tokenizer versions of the query below, files of public_tokenizers.
VERSIONS = ("word_bpe_49k", "byte_bpe_50k")


def counted(docs: DataFrame, versions: tuple[str, str] = VERSIONS) -> DataFrame:
    """source, lang, doc_id, digest of the text, tokens by both versions, and by the second without repeated lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = (encoder(f"{v}.json") for v in versions)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                first, second, revised = [], [], []
                for text in part.column("text").to_pylist():
                    first.append(one.count(text))
                    second.append(two.count(text))
                    lines = text.split("\n")
                    once = dict.fromkeys(lines)
                    revised.append(second[-1] if len(once) == len(lines) else two.count("\n".join(once)))
                columns = [part.column(c) for c in ("source", "lang", "doc_id", "digest")]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in (first, second, revised))], ["source", "lang", "doc_id", "digest", "first", "second", "revised"])

    picked = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(whole().cast("binary")).alias("digest"), whole().cast("string").alias("text"))
    return picked.mapInArrow(run, "source string, lang string, doc_id long, digest string, first long, second long, revised long")


def maintained(docs: DataFrame, path: str | None = None, versions: tuple[str, str] = VERSIONS) -> DataFrame:
    """Loads all documents, rolls out a second tokenizer, revises its counts by leaving out repeated lines of a text, and
    withdraws all but the first of equal texts (of the smallest doc_id); two batches are replayed and the store is compacted between."""
    rows = saved(counted(docs, versions), "rollup-counts")
    store = Rollups(docs.sparkSession, path)
    none = F.lit(None).cast("long").alias("old_tokens")
    v1, v2 = versions

    def change(df: DataFrame, kind: str, version: str, n: str, old=none) -> DataFrame:  # noqa: ANN001
        return df.select(F.lit(kind).alias("kind"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(n).alias("n_tokens"), old, *(["copies"] if "copies" in df.columns else []))

    rollout = change(rows, "insert", v2, "second")
    revised = rows.where("revised <> second")
    # Equal texts of a source and language are counted before anything is joined by text, so a text with very many copies
    # is a few rows by then.  The order of doc_ids has null first.
    place = F.struct(F.col("doc_id").isNotNull().alias("named"), "doc_id")
    each = rows.groupBy("digest", "source", "lang", place.alias("place"), "first", "revised").agg(F.count("*").alias("n"))
    same = each.groupBy("digest", "source", "lang", "first", "revised").agg(F.sum("n").alias("n"), F.min("place").alias("least"), F.min_by("n", "place").alias("n_least"))
    again = same.join(same.groupBy("digest").agg(F.min("least").alias("kept")), "digest")
    again = again.withColumn("copies", F.col("n") - F.when(F.col("least") == F.col("kept"), F.col("n_least")).otherwise(0)).where("copies > 0")
    again = saved(again.select("source", "lang", "first", "revised", "copies"), "rollup-again")
    withdrawn = change(again, "delete", v1, "first").unionByName(change(again, "delete", v2, "revised"))
    store.commit("load", change(rows, "insert", v1, "first"))
    store.commit("rollout", rollout)
    store.commit("revision", change(revised, "revise", v2, "revised", F.col("second").alias("old_tokens")))
    store.compact()
    store.commit("withdrawal", withdrawn)
    store.commit("rollout", rollout)
    store.commit("withdrawal", withdrawn)
    return store.totals()
