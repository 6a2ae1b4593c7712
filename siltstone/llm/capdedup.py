"""Operator 4: near-duplicate embeddings by spherical-cap filters.

Vectors of one label are turned by a fixed random rotation and cut into blocks; each block has a code of random unit
directions, and every combination of one direction a block is a filter direction.  A vector belongs to all filters whose
direction its inner product exceeds the cap's height; they are list-decoded block by block, dropping partial sums that
can't reach it any more.  Vectors that share a filter meet there, and their cosine is computed in double precision.

Height and number of filters follow from the rows of the largest label: a filter holds about PER_FILTER vectors however many
there are, and a pair at the threshold shares one with probability RECALL (closer pairs: more; measured recall is in the
README).  Of short vectors a cap that small would hold neighbours of none of its members: a cap is never so small that a pair
at the threshold shares one cap in LEAST_SHARED or less often.  Equal vectors are compared once.

Two rounds.  In the first, vectors meet as sketches of 128 signs of random directions, and a vector goes on to the second in
those filters alone in which some other sketch is within NEAR_SIGNS of its own (at the threshold, cosine 0.93, a pair differs
in 15 on average, and in more than 40 once in 1e9).  In the second the vectors themselves meet and their cosine decides.  So
vectors that have no near one, most of them, are shuffled once.

Filters with more than SPLIT vectors (groups of near copies) skip the first round and are cut into chunks, and pairs of chunks
go to different tasks.  A pair is counted in the first filter that its vectors share, and only there; counts and a spanning
forest leave a task, not the pairs.

Defined results: a vector that is null, empty, zero or holds a null or non-finite component, or whose label is null, links with
nothing; vectors of different length don't link; equal vectors of a label always do.  Rows with one vec_id are separate
vectors of one name.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import components, partitions, saved
from siltstone.llm.simhash import _roots

THRESHOLD, RECALL, PER_FILTER, SPLIT = 0.93, 0.9999, 64, 2_048
TILE = 1_024
LEAST_SHARED = 0.2
SIGNS, NEAR_SIGNS = 128, 40
MOST_WORDS = 2_048  #: directions of a block's code, about


GRID = np.linspace(-1, 1, 20_001)


def cap_share(height: np.ndarray | float, dim: int) -> np.ndarray:
    """Share of the unit sphere whose inner product with a direction is at least `height`."""
    if dim == 1:  # two points
        return 0.5 * (np.asarray(height) <= 1) + 0.5 * (np.asarray(height) <= -1)
    if dim == 2:
        return np.arccos(np.clip(height, -1, 1)) / np.pi
    density = np.cumsum((1 - np.clip(GRID, -1, 1) ** 2) ** ((dim - 3) / 2))
    return 1 - np.interp(height, GRID, density / density[-1])


def shared_share(height: float, cosine: float, dim: int) -> float:
    """Chance that a vector at this cosine is in a cap of this height that holds the other one."""
    if dim == 1:
        return 1.0
    x = np.linspace(height, 0.999, 4001)
    need = (height - cosine * x) / np.sqrt((1 - cosine**2) * (1 - x**2))
    weight = (1 - x**2) ** ((dim - 3) / 2)
    return float((weight * cap_share(need, dim - 1)).sum() / weight.sum())


@dataclass(frozen=True)
class Filters:
    """Filter directions for vectors of one length: blocks of a rotated space, and a code for each."""

    dim: int
    blocks: int
    words: int
    height: float
    seed: int = 20_011

    @staticmethod
    def design(dim: int, rows: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Filters:
        """rows: of the largest label."""
        if dim == 1:  # a cap for each of the two points
            return Filters(1, 1, 2, 0.5)
        share = min(0.05, PER_FILTER / max(rows, 1))
        low, high = 0.0, 1.0
        while high - low > 1e-9:
            mid = (low + high) / 2
            low, high = (mid, high) if cap_share(mid, dim) > share and shared_share(mid, threshold, dim) > LEAST_SHARED else (low, mid)
        share = float(cap_share(low, dim))
        hits = -math.log(1 - recall) / shared_share(low, threshold, dim)
        blocks = max(1, min(dim // 8, math.ceil(math.log(hits / share) / math.log(MOST_WORDS))))
        # Filters that share block directions aren't independent; codes of few words need more of them.
        hits *= 1 + 0.25 * (blocks - 1)
        return Filters(dim, blocks, max(2, math.ceil((hits / share) ** (1 / blocks))), low)

    def parts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.dim), self.blocks)

    def tables(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """The rotation, and each block's code; filter directions have length one as a whole."""
        rng = np.random.default_rng(self.seed)
        turn = np.linalg.qr(rng.normal(size=(self.dim, self.dim)))[0]
        codes = []
        if self.dim == 1:  # its two points
            return turn, [np.resize([[1.0], [-1.0]], (self.words, 1))]
        for p in self.parts():
            c = rng.normal(size=(self.words, len(p)))
            codes.append(c / np.linalg.norm(c, axis=1, keepdims=True) * math.sqrt(len(p) / self.dim))
        return turn, codes

    def decode(self, x: np.ndarray, turn: np.ndarray, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """x: unit vectors.  Pairs (row, filter) of all filters that the rows exceed."""
        y = x @ turn
        dots = [y[:, p] @ c.T for p, c in zip(self.parts(), codes, strict=True)]
        rest = np.cumsum([d.max(1) for d in dots[::-1]], axis=0)[::-1]
        row, name, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for k, d in enumerate(dots):
            need = self.height - (rest[k + 1] if k + 1 < self.blocks else np.zeros(len(x)))
            rows, names, totals = [], [], []
            for lo in range(0, len(row), max(1, (1 << 22) // self.words)):
                part = slice(lo, lo + max(1, (1 << 22) // self.words))
                sums = total[part, None] + d[row[part]]
                i, j = np.nonzero(sums >= need[row[part], None])
                rows.append(row[part][i])
                names.append(name[part][i] * self.words + j)
                totals.append(sums[i, j])
            row, name, total = (np.concatenate([z[:0], *w]) for z, w in ((row, rows), (name, names), (total, totals)))
        return row, name


def with_use(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector, and whether the row can link."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("vector"), F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)).alias("use"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of extreme components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filed(classes: DataFrame, dim: int, filters: Filters) -> DataFrame:
    """label_key, rep, copies, vector, filters (all that hold it, ascending), s0, s1 (the sketch)."""
    kind = classes.schema["vector"].dataType
    names = ["label_key", "rep", "copies", "vector", "filters", "s0", "s1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, codes = filters.tables()
        signs = np.random.default_rng(filters.seed + 1).normal(size=(dim, SIGNS))
        for whole in batches:
            for lo in range(0, len(whole), 256):
                batch = whole.slice(lo, 256)
                x = _matrix(batch.column("vector"), dim)
                row, name = filters.decode(x, turn, codes)
                order = np.lexsort((name, row))
                at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(batch)))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(name[order]))
                sketch = np.packbits(x @ signs > 0, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), lists, pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1]))], names)

    return classes.select(*names[:4]).mapInArrow(run, f"label_key string, rep long, copies long, vector {kind.simpleString()}, filters array<long>, s0 long, s1 long")


def near_by_sketch(s: np.ndarray) -> np.ndarray:
    """Which of the sketches (rows of two words) have another within NEAR_SIGNS."""
    out = np.zeros(len(s), bool)
    for lo in range(0, len(s), 512):
        differ = np.bitwise_count(s[lo : lo + 512, None, 0] ^ s[None, :, 0]) + np.bitwise_count(s[lo : lo + 512, None, 1] ^ s[None, :, 1])
        differ[np.arange(len(differ)), np.arange(lo, lo + len(differ))] = 255
        out[lo : lo + 512] = (differ <= NEAR_SIGNS).any(1)
    return out


def _sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by label and filter; those go on that have a near sketch there.  Of a filter no more than SPLIT rows
    are held: where more come, all go on."""
    keep = ["rep", "filter", "nth"]
    held: list[pa.RecordBatch] = []
    rows = 0
    open_ = False  # whether the group at hand has passed SPLIT, so that its rows go straight on

    def sifted(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        label, name = (table.column(c).to_numpy() for c in ("label_key", "filter"))
        s = np.stack([table.column(c).to_numpy() for c in ("s0", "s1")], 1).view(np.uint64)
        new = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (name[1:] != name[:-1])]))
        on = np.zeros(table.num_rows, bool)
        for lo, hi in zip(new, [*new[1:], table.num_rows], strict=True):
            on[lo:hi] = hi - lo > SPLIT or hi - lo > 1 and near_by_sketch(s[lo:hi])
        yield from table.select(keep).filter(pa.array(on)).to_batches()

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return batch.column("label_key")[i].as_py(), batch.column("filter")[i].as_py()

    for batch in batches:
        while len(batch):
            first, last = key(batch, 0), key(batch, len(batch) - 1)
            if held and key(held[0], 0) != first:
                yield from sifted(pa.Table.from_batches(held))
                held, rows, open_ = [], 0, False
            if first != last:  # up to where its last group begins all groups are whole
                lo, hi = 0, len(batch)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (lo, mid) if key(batch, mid) == last else (mid + 1, hi)
                if open_:
                    end = 0
                    while key(batch, end) == first:
                        end += 1
                    yield batch.slice(0, end).select(keep)
                    held, rows, open_, batch = [], 0, False, batch.slice(end)
                    continue
                yield from sifted(pa.Table.from_batches([*held, batch.slice(0, lo)]))
                held, rows, batch = [], 0, batch.slice(lo)
                continue
            if open_:
                yield batch.select(keep)
            else:
                held.append(batch)
                rows += len(batch)
                if rows > SPLIT:
                    yield from (b.select(keep) for b in held)
                    held, open_ = held[:1], True
                    held[0] = held[0].slice(0, 1)
            batch = batch.slice(len(batch))
    if held and not open_:
        yield from sifted(pa.Table.from_batches(held))


def _first_shared(lists: list[np.ndarray], this: int) -> np.ndarray:
    """Members' earlier filters as a matrix of zeros and ones, for filters that two members or more have."""
    who = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    what = np.concatenate([np.zeros(0, np.int64), *lists])
    earlier = what < this
    who, what = who[earlier], what[earlier]
    names, code, count = np.unique(what, return_inverse=True, return_counts=True)
    use = count[code] > 1
    _, code = np.unique(code[use], return_inverse=True)
    m = np.zeros((len(lists), int(code.max(initial=-1)) + 1), np.float32)
    m[who[use], code] = 1
    return m


def block_links(x: np.ndarray, copies: np.ndarray, lists: list[np.ndarray], this: int, split: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links counted in this filter: of each member the copies it links with, and a forest (a, b).

    split: which of two chunks a member is in, if only pairs across are asked for."""
    n = len(x)
    earlier = _first_shared(lists, this)
    count, root = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, n, TILE):
        rows = slice(lo, lo + TILE)
        new = x[rows] @ x.T >= THRESHOLD
        if earlier.shape[1]:
            new &= earlier[rows] @ earlier.T == 0
        new[np.arange(len(new)), np.arange(lo, lo + len(new))] = False
        if split is not None:
            new &= split[rows, None] != split[None, :]
        count[rows] = new @ copies
        a, b = np.nonzero(new)
        keep = a + lo > b
        a, b = root[a[keep] + lo], root[b[keep]]
        differ = a != b
        if differ.any():
            # Tie what this tile joins; roots only ever fall.
            root = _roots(n, np.concatenate([a[differ], np.arange(n)]), np.concatenate([b[differ], root]))
    tied = np.flatnonzero(root != np.arange(n))
    return count, tied, root[tied]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by label, filter and chunks; a group is handled when its last row has come."""
    held: list[pa.RecordBatch] = []

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        table = table.combine_chunks()
        col = {c: table.column(c).chunk(0) for c in table.column_names}
        keys = [col[c].to_numpy(zero_copy_only=False) for c in ("label_key", "filter", "one", "two")]
        new = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
        end = np.concatenate([new[1:], [table.num_rows]])
        rep, copies, chunk = (col[c].to_numpy(zero_copy_only=False) for c in ("rep", "copies", "chunk"))
        x = _matrix(col["vector"], len(col["vector"][0]))
        at, lists = col["filters"].offsets.to_numpy(), col["filters"].values.to_numpy()
        out: list[list[np.ndarray]] = [[], [], []]
        for lo, hi in zip(new, end, strict=True):
            if hi - lo < 2:
                continue
            across = keys[2][lo] != keys[3][lo]
            count, a, b = block_links(x[lo:hi], copies[lo:hi], [lists[at[i] : at[i + 1]] for i in range(lo, hi)], int(keys[1][lo]), chunk[lo:hi] if across else None)
            linked = np.flatnonzero(count)
            out[0] += [rep[lo:hi][linked], rep[lo:hi][a]]
            out[1] += [count[linked], rep[lo:hi][b]]
            out[2] += [np.zeros(len(linked), bool), np.ones(len(a), bool)]
        none = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *out[0]])), pa.array(np.concatenate([none, *out[1]])), pa.array(np.concatenate([none.astype(bool), *out[2]]))], ["a", "b", "is_link"])

    def key(batch: pa.RecordBatch, i: int) -> tuple:
        return tuple(batch.column(c)[i].as_py() for c in ("label_key", "filter", "one", "two"))

    for batch in batches:
        if not len(batch):
            continue
        last, lo, hi = key(batch, len(batch) - 1), 0, len(batch)
        while lo < hi:  # first row of the last group
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if key(batch, mid) == last else (mid + 1, hi)
        if not lo and held and key(held[0], 0) == last:
            held.append(batch)
            continue
        yield from work(pa.Table.from_batches([*held, batch.slice(0, lo)]))
        held = [batch.slice(lo)]
    if held:
        yield from work(pa.Table.from_batches(held))


def met(vectors: DataFrame) -> DataFrame:
    """a, b, is_link from filed() vectors: counts (rep, copies linked with) and links of a spanning forest.

    Who meets whom is settled on narrow rows; vectors join what is left of them and are dealt out once, each with those of
    its filters that come before the one it is dealt to."""
    n = partitions(vectors.sparkSession)
    vectors = saved(vectors, "caps-filed")
    rows = vectors.select("label_key", "rep", "s0", "s1", F.posexplode("filters").alias("nth", "filter"))
    sifted = rows.repartition(n, "label_key", "filter").sortWithinPartitions("label_key", "filter").mapInArrow(_sift, "rep long, filter long, nth int")
    sifted = saved(sifted, "caps-near")
    wide = vectors.select("label_key", "rep", "copies", "vector", "filters")
    dealt = sifted.join(wide, "rep").withColumn("filters", F.slice("filters", 1, F.col("nth")))
    # Filters that a group of near copies crowds are cut into chunks; their sizes are of those that went on.
    names = vectors.select("rep", "label_key")
    large = sifted.join(names, "rep").groupBy("label_key", "filter").agg(F.count("*").alias("size")).where(F.col("size") > SPLIT)
    large = saved(large.select(F.col("label_key").alias("of"), F.col("filter").alias("crowded"), F.ceil(F.col("size") / SPLIT).cast("int").alias("chunks")), "caps-large")
    zero = F.lit(0)
    if large.isEmpty():
        dealt = dealt.withColumns({"chunk": zero, "one": zero, "two": zero})
    else:
        dealt = dealt.join(large, (F.col("label_key") == F.col("of")) & (F.col("filter") == F.col("crowded")), "left")
        dealt = dealt.withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(zero, F.col("chunks") - 1)))
        dealt = dealt.withColumns({"one": F.least("chunk", "other"), "two": F.greatest("chunk", "other")}).drop("chunks", "other", "of", "crowded")
    dealt = dealt.drop("nth").repartition(n, "label_key", "filter", "one", "two").sortWithinPartitions("label_key", "filter", "one", "two")
    return dealt.mapInArrow(_meet, "a long, b long, is_link boolean")


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    all_ = with_use(vectors)
    good = all_.where("use").withColumn("label_key", F.concat_ws(":", F.size("vector"), "label"))
    classes = good.groupBy("label_key", "vector").agg(F.min("vec_id").alias("named"), F.count("*").alias("copies"))
    # Classes get a number of their own: two of them may share a vec_id, or have none.
    classes = saved(classes.withColumn("rep", F.monotonically_increasing_id()), "caps-classes")
    found = None
    sizes = classes.groupBy(F.size("vector").alias("dim"), "label_key").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row for each length
    for dim, n in sorted(map(tuple, sizes)):
        part = met(filed(classes.where(F.size("vector") == dim), dim, Filters.design(dim, n)))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    found = saved(found, "caps-found")
    counts = found.where("not is_link").groupBy("a").agg(F.sum("b").alias("linked"))
    ties = components(found.where("is_link").select("a", "b"), "caps-links")
    info = classes.select("label_key", "vector", "rep", "copies", "named")
    info = saved(info.join(counts, info.rep == counts.a, "left").join(ties, info.rep == ties.id, "left").withColumn("root", F.coalesce("component", "rep")), "caps-info")
    least = info.groupBy("root").agg(F.min("named").alias("component_id"))
    info = saved(info.join(least, "root").select("label_key", "vector", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "caps-classes")
    ours = good.join(info, ["label_key", "vector"]).select("vec_id", "n_links", "component_id")
    rest = all_.where("not use")
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ours.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
