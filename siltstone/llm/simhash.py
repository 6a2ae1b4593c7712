"""Operator 5: SimHash near-duplicates through a segment-popcount embedding.

A fingerprint of 64 bits is cut into 16 segments of 4 bits; the bit counts of the segments are a point of a grid, and
flipping a bit moves the point by one step.  So the Manhattan distance of two points never exceeds the Hamming distance
of their fingerprints.  Fingerprints at most two bits apart are at most two steps apart, hence both within one step of a
common grid point: the range join sends every distinct fingerprint to its own point and to the at most 32 neighbours of
that, and what meets in a point is verified exactly.  Rows grow with the distinct fingerprints, not with pairs.

Small groups in a point are compared pair by pair; larger ones by their balls of one flipped bit, which two fingerprints
share if and only if they differ in two bits or fewer; points that are crowded beyond a bound are dealt out by balls instead
(links).  All emit a chain or the few links themselves, never all pairs of a large group, and lose no connection.

Defined results: a null or wordless text has fingerprint zero and links like any other; equal fingerprints always link;
a row with a null doc_id gets its class but never names it (null if the whole class has none).  Only doc_id and text are
read, so clashing or odd other columns do no harm.  Repeated rows come back as often as they came.  A text's words and
hashes are held in memory while it is read, about 100 bytes a word, so the longest text bounds a task's need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.bpe import forget
from siltstone.llm.common import components, free_name, partitions, saved

SEED, SHINGLE, RADIUS = 42, 3, 2
PAIRWISE = 48  #: larger groups in a grid point are linked by balls
DENSE = 256  #: fingerprints whose own grid point is the same, beyond which those around it are dealt out by balls


def fingerprint(text: str | None) -> int:
    """Of the lower-cased (A-Z) words' shingles; a bit is set if it is in over half of their hashes."""
    import xxhash

    words = (text or "").encode().lower().split()  # both work on ASCII alone for bytes
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < SHINGLE:
        hashes = [digest(join(words), SEED)]
    else:
        hashes = [digest(join(x), SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    ones = bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _hash(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            fps = np.fromiter((fingerprint(x.as_py()) for x in batch.column("text")), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fps.view(np.int64))], ["doc_id", "h", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash("text").alias("h"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, h long, fp long")


def grid_point(fp: Column) -> Column:
    """Bit counts of the 16 segments, one in each half-byte."""
    odd, low = F.lit(0x5555555555555555), F.lit(0x3333333333333333)
    a, b = fp.bitwiseAND(odd), F.shiftrightunsigned(fp, 1).bitwiseAND(odd)
    pairs = F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))  # a + b for each pair, which as a signed sum could overflow
    return pairs.bitwiseAND(low) + F.shiftrightunsigned(pairs, 2).bitwiseAND(low)


def nearby_points(point: Column) -> Column:
    """The grid point and those one step away: counts stay within 0 and 4."""
    out = [point]
    for k in range(16):
        step = 1 << 4 * k
        count = F.shiftrightunsigned(point, 4 * k).bitwiseAND(F.lit(15))
        out += [F.when(count < 4, point + F.lit(step)), F.when(count > 0, point - F.lit(step))]
    return F.array_compact(F.array(*out))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable through the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
    return root


def ball_links(fp: np.ndarray, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect just those of the distinct fingerprints that chains of two bits or fewer connect."""
    n = len(fp)
    flips = np.concatenate([[0], 1 << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    chunks = max(1, n * 65 // chunk)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for c in range(chunks):
        centre, owner = [], []
        for flip in flips:
            x = fp ^ flip
            mine = np.flatnonzero(x % np.uint64(chunks) == c) if chunks > 1 else np.arange(n)
            centre.append(x[mine])
            owner.append(mine)
        x, who = np.concatenate(centre), np.concatenate(owner)
        order = np.argsort(x, kind="stable")
        x, who = x[order], who[order]
        same = np.flatnonzero(x[1:] == x[:-1])
        links.append((who[same], who[same + 1]))
    a, b = (np.concatenate(z) for z in zip(*links, strict=True))
    root = _roots(n, a, b)
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def group_links(point: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows that are sorted by point; rep names a fingerprint."""
    new = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
    size = np.diff(np.concatenate([new, [len(point)]]))
    a_out, b_out = [], []
    small = np.repeat(size <= PAIRWISE, size)
    for k in range(1, int(size[size <= PAIRWISE].max(initial=1))):
        at = np.flatnonzero((point[k:] == point[:-k]) & small[k:])
        near = at[np.bitwise_count(fp[at] ^ fp[at + k]) <= RADIUS]
        a_out.append(rep[near])
        b_out.append(rep[near + k])
    for start, n in zip(new[size > PAIRWISE], size[size > PAIRWISE], strict=True):
        a, b = ball_links(fp[start : start + n])
        a_out.append(rep[start + a])
        b_out.append(rep[start + b])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a_out]), np.concatenate([none, *b_out])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by point; the last point of a batch waits for the next batch."""
    forget()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def out(rows: list) -> pa.RecordBatch:
        point, fp, rep = (np.concatenate(x) for x in zip(*rows, strict=True))
        a, b = group_links(point, fp.view(np.uint64), rep)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        if not len(batch):
            continue
        cols = tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("point", "fp", "rep"))
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if held and (cut or held[0][0][0] != cols[0][0]):
            yield out([*held, tuple(c[:cut] for c in cols)])
            held = []
        elif cut:
            yield out([tuple(c[:cut] for c in cols)])
        held.append(tuple(c[cut:] for c in cols))
    if held:
        yield out(held)


def links(distinct: DataFrame, dense: int = DENSE) -> DataFrame:
    """distinct: fp (no repeats), rep.  Links a, b between reps that connect what two bits or fewer connect.

    Grid points within a step of one that over `dense` fingerprints have as their own are crowded.  Who is in a crowded point
    is not met there but in balls: it goes to its own fingerprint and the 64 that differ in one bit, and two fingerprints
    share such a place if and only if they differ in two bits or fewer; no place has more than 65.  So no point that is left
    holds more than 33 * dense rows, however many near copies there are."""
    points = distinct.select("fp", "rep", grid_point(F.col("fp")).alias("own"))
    crowded = points.groupBy("own").agg(F.count("*").alias("n")).where(F.col("n") > dense).select(F.explode(nearby_points(F.col("own"))).alias("point")).distinct()
    crowded = saved(crowded, "simhash-crowded")
    rows = points.select(F.explode(nearby_points(F.col("own"))).alias("point"), "fp", "rep")
    some = not crowded.isEmpty()
    met = rows.join(crowded, "point", "left_anti") if some else rows
    dealt = met.repartition(partitions(distinct.sparkSession), "point").sortWithinPartitions("point")
    found = dealt.mapInArrow(_links, "a long, b long")
    if some:
        inside = rows.join(crowded, "point", "left_semi").select("fp", "rep").distinct()
        places = inside.select(F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit((1 << k) - (1 << 64) * (k == 63))) for k in range(64)))).alias("place"), "rep")
        before = F.lag("rep").over(Window.partitionBy("place").orderBy("rep"))
        found = found.unionByName(places.select(before.alias("a"), F.col("rep").alias("b")).where("a is not null"))
    return found.distinct()


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows' prints (doc_id, h, fp), and of each fingerprint its class (the smallest fingerprint in it, which is no
    doc_id: texts that share a doc_id may be in different classes) and the smallest doc_id of that."""
    prints = saved(fingerprints(docs), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("named")), "simhash-distinct")
    classes = components(links(distinct.select("fp", F.col("fp").alias("rep"))), "simhash-links")
    found = saved(distinct.join(classes, distinct.fp == classes.id, "left").select("fp", "named", F.coalesce("component", "fp").alias("class")), "simhash-classes")
    least = found.groupBy("class").agg(F.min("named").alias("component_id"))
    return prints, saved(found.drop("named").join(least, "class"), "simhash-named")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the class)."""
    prints, named = _classes(docs)
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, or where no row of the class has one, of the smallest
    fingerprint and text hash.  Rows that share a doc_id but not a text are told apart by a hash of the text, each judged in
    its own class; of rows equal in both one stays.

    Who stays is settled on narrow rows; texts are neither sorted nor compared, and any kind of column may ride along."""
    prints, named = _classes(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")).alias("k")
    keep = prints.join(named, "fp").groupBy("class").agg(first).select("k.doc_id", "k.h")
    copies = prints.groupBy("doc_id", "h").agg(F.count("*").alias("n"))
    keep = saved(keep.alias("k").join(copies.alias("c"), F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("k.h") == F.col("c.h"))).select(F.col("k.doc_id").alias("keep_id"), F.col("k.h").alias("keep_h"), "n"), "simhash-kept")
    hashed = free_name(docs, "h")
    rows = docs.withColumn(hashed, _hash("text"))

    def kept(which: DataFrame) -> DataFrame:
        same = rows["doc_id"].cast("long").eqNullSafe(which["keep_id"]) & (rows[hashed] == which["keep_h"])
        return rows.join(which, same, "left_semi")

    again = keep.where("n > 1")
    out = kept(keep.where("n = 1"))
    if not again.isEmpty():
        out = out.unionByName(kept(again).dropDuplicates(["doc_id", hashed]))
    return out.drop(hashed)
