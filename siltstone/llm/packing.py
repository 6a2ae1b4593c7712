"""Operator 6: best-fit packing after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any number of pieces is a histogram of at most
`capacity` counts.  The reduction and the best fit work on that histogram: the driver holds nothing that grows with the
corpus, and the plan (which ranks of which length go to which sequences) is a table whose size has the same bound; it alone
is broadcast.

Defined results: a null text counts as empty (one token, the end id); pieces of repeated rows are packed like any other;
a piece keeps its row's doc_id, null included; an empty table gives no pieces.  Columns beside doc_id and text are not read,
so clashing names do no harm.  A text and its ids are held in memory while it is cut.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.bpe import encoder
from siltstone.llm.common import saved

PIECES = "part int, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"


class Plan:
    """Patterns: (how many sequences, {length: how many of it in each})."""

    def __init__(self) -> None:
        self.patterns: list[tuple[int, dict[int, int]]] = []

    def add(self, n: int, content: dict[int, int]) -> None:
        if n:
            self.patterns.append((n, content))


def reduce_by_dominance(counts: Counter, capacity: int, plan: Plan) -> None:
    """Fixes sets that dominate every other set with the same piece, and takes their pieces out of counts.

    For a piece j, a set {j, k} dominates all sets with j if k is the largest piece that fits beside it and either fills
    the sequence, or no two pieces fit beside j, or any two that do fit need no more room than k.  All are applied to as
    many equal pieces at once as there are: taking pieces away never makes such a set worse."""

    def sizes() -> list[int]:
        return sorted(x for x, n in counts.items() if n)

    def smallest(without: int, n: int) -> list[int]:
        out: list[int] = []
        for x in sizes():
            out += [x] * min(n - len(out), counts[x] - (x == without))
            if len(out) >= n:
                break
        return out

    changed = True
    while changed:
        changed = False
        for j in sizes()[::-1]:
            while counts[j]:
                room = capacity - j
                k = max((x for x in sizes() if x <= room and counts[x] - (x == j) > 0), default=0)
                if not k:
                    plan.add(counts[j], {j: 1})
                    counts[j], changed = 0, True
                    break
                low = smallest(j, 3)
                fixed = k == room or len(low) < 2 or sum(low[:2]) > room
                if not fixed and (len(low) < 3 or sum(low) > room):
                    fixed = best_pair(counts, j, room) <= k
                if not fixed:
                    break
                n = counts[j] // 2 if k == j else min(counts[j], counts[k])
                plan.add(n, {j: 2} if k == j else {j: 1, k: 1})
                counts[j] -= n * (1 + (k == j))
                if k != j:
                    counts[k] -= n
                changed = True


def best_pair(counts: Counter, j: int, room: int) -> int:
    """Largest sum within room of two pieces other than one j."""
    have = sorted(x for x, n in counts.items() if n - (x == j) > 0)
    best, hi = 0, len(have) - 1
    for lo, x in enumerate(have):
        while hi >= lo and x + have[hi] > room:
            hi -= 1
        for y in have[max(lo, hi - 1) : hi + 1][::-1]:
            if x != y or counts[x] - (x == j) > 1:
                best = max(best, x + y)
                break
    return best


def best_fit(counts: Counter, capacity: int, plan: Plan) -> None:
    """Best fit by descending length, with as many equal sequences at once as possible."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = defaultdict(list)  # by the room that is left

    def put(n: int, room: int, content: dict[int, int], length: int, each: int) -> None:
        if n:
            open_[room - each * length].append((n, content | ({length: content.get(length, 0) + each} if each else {})))

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            n, content = (left, {}) if room is None else open_[room].pop()
            room = capacity if room is None else room
            each = room // length
            filled = min(n, left // each)
            left -= filled * each
            rest = n - filled
            put(filled, room, content, length, each)
            if left and rest:
                put(1, room, content, length, left)
                left, rest = 0, rest - 1
            if content:
                put(rest, room, content, length, 0)
    for found in open_.values():
        plan.patterns += found


def solve(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    counts, plan = Counter({x: n for x, n in histogram.items() if n}), Plan()
    reduce_by_dominance(counts, capacity, plan)
    best_fit(counts, capacity, plan)
    return plan.patterns


def runs(patterns: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """length, first rank, rank after the last, first sequence, sequences, first offset: where the ranks of a length go."""
    out, rank, base = [], Counter(), 0
    for n, content in patterns:
        at = 0
        for length, each in sorted(content.items(), reverse=True):
            out.append((length, rank[length], rank[length] + n * each, base, n, at))
            rank[length] += n * each
            at += length * each
        base += n
    return out


def pack(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """pieces: part, length (1 to capacity), local_rank (0.. within a part and length) and any others; adds sequence_id and offset.

    The plan that is broadcast has a row for each pattern and length in it: bounded by the capacity, whatever the input."""
    spark = pieces.sparkSession
    per_part = saved(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    histogram = {r.length: r.n for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(runs(solve(histogram, capacity)), "p_length long, lo long, hi long, base long, n_seq long, at long")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_base"))
    # base has a row for each part and length, so it grows with the corpus: it meets the (narrow) pieces by a shuffle.
    ranked = pieces.join(base.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank_base") + F.col("local_rank"))
    q = F.col("rank") - F.col("lo")
    return ranked.join(F.broadcast(plan), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        *(c for c in pieces.columns if c not in ("part", "local_rank")),
        (F.col("base") + q % F.col("n_seq")).alias("sequence_id"),
        (F.col("at") + F.floor(q / F.col("n_seq")).cast("long") * F.col("length")).alias("offset"),
    )


def cut(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces of all documents: only those longer than the capacity are cut, and then only the first piece is shorter."""
    from pyspark import TaskContext

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, rank = encoder(tokenizer), TaskContext.get().partitionId(), Counter()
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = memoryview(enc.encode(text.as_py()) + end)
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    length = (n - 1) % capacity + 1 if at == 0 else capacity
                    rows.append((part, doc_id, k, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)]), rank[length]))
                    rank[length] += 1
                    at, k = at + length, k + 1
            columns = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document."""
    return pack(cut(docs, tokenizer, end_id, capacity), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
