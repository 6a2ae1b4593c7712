import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import simhash
from siltstone.llm.common import components


def slow_print(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    s = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_classes(fps):
    root = list(range(len(fps)))
    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


@pytest.mark.parametrize("text", [None, "", "  \n", "One", "One two", "a b c", "A b\tC d\x0be", "É é ÀB cd ef gh", "x " * 500, "nb sp a b"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_print(text)


def test_grid_points_bound_the_distance(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for _ in range(rng.randint(0, 2)):
            b ^= 1 << rng.randrange(64)
        pairs.append((a - (a >> 63 << 64), b - (b >> 63 << 64)))
    pairs += [(0, 0), (-1, -1), (-1, -2), (1 << 62, -(1 << 63))]
    df = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.grid_point(F.col("a")).alias("p"), simhash.nearby_points(simhash.grid_point(F.col("a"))).alias("pa"), simhash.nearby_points(simhash.grid_point(F.col("b"))).alias("pb"))
    for r in df.collect():
        assert r.p == sum(((r.a >> 4 * k) & 15).bit_count() << 4 * k for k in range(16))
        if ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2:
            assert set(r.pa) & set(r.pb)


@pytest.mark.parametrize("spread", [6, 40])
def test_links_of_large_and_small_groups(spread):
    rng = random.Random(spread)
    centre = rng.getrandbits(64)
    fps = set()
    while len(fps) < 150:
        x = centre
        for _ in range(rng.randint(0, 5)):
            x ^= 1 << rng.randrange(spread)
        fps.add(x)
        if spread == 6 and len(fps) == 60:
            break
    fps = sorted(fps)
    want = slow_classes(fps)
    a, b = simhash.ball_links(np.array(fps, np.uint64), chunk=1000)
    root = simhash._roots(len(fps), a, b).tolist()
    assert root == want
    assert all((fps[i] ^ fps[j]).bit_count() >= 0 for i, j in zip(a, b, strict=True)) and len(a) < len(fps)


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(9)
    base = [" ".join(rng.choices("alpha beta gamma delta eps zeta eta theta".split(), k=rng.randint(3, 60))) for _ in range(60)]
    texts = base + [t.upper() for t in base[:10]] + [t + " extra" for t in base[:30]] + [None, "", " "] + base[:5]
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts, [0] * len(ids), strict=True)) + [(None, base[0], 0), (None, "only here without a name at all", 0)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long")).collect()
    assert len(got) == len(rows)
    fps = [slow_print(t) for _, t, _ in rows]
    root = slow_classes(fps)
    least = {}
    for (i, *_), r in zip(rows, root, strict=True):
        least[r] = min(x for x in (i, least.get(r)) if x is not None) if (i, least.get(r)) != (None, None) else None
    want = sorted(((i, f"{f:016x}", least[r]) for (i, *_), f, r in zip(rows, fps, root, strict=True)), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each_keeps_columns(spark):
    rows = [(2, "a b c d", "x"), (1, "A B C D", "y"), (1, "A B C D", "y"), (3, "quite another text here", None), (None, "no id", "z")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, place string"))
    assert got.columns == ["doc_id", "text", "place"] and sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 3]


def test_components_of_long_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1100)] + [(5000, 5000)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(201)) and all(got[k] == 1000 for k in range(1000, 1100)) and 5000 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_with_maps_clashing_ids_and_none(spark):
    other = "quite another text with words of its own"
    rows = [(5, "a b c d"), (5, "a b c d"), (5, other), (7, other.upper()), (9, "A B C D"), (None, "a b c d"), (None, "no id at all here"), (None, "no id at all here"), (3, "x " * 50_000), (4, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id int, text string").withColumns({"m": F.create_map(F.lit("k"), F.col("text")), "h": F.lit(1), "class": F.lit("c"), "fp": F.array(F.lit(1))})
    got = simhash.one_of_each(df)
    assert got.columns == df.columns
    # one row a class: 5's first text, 5's other text in a class of its own, one of those without an id, 3 for 3 and 4
    assert sorted((r.doc_id or 0, r.text[:7], len(r.m)) for r in got.collect()) == [(0, "no id a", 1), (3, "x x x x", 1), (5, "a b c d", 1), (5, "quite a", 1)]
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_crowded_points_lose_no_link(spark):
    rng = random.Random(21)
    fps = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(120):
            x = centre
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps | {0, (1 << 64) - 1, (1 << 63), (1 << 63) | 1})
    want = slow_classes(fps)
    df = spark.createDataFrame([(x - (x >> 63 << 64), k) for k, x in enumerate(fps)], "fp long, rep long")
    for dense in (1, 4, 10_000):
        got = {r.id: r.component for r in components(simhash.links(df, dense)).collect()}
        assert [got.get(k, k) for k in range(len(fps))] == want


def test_hubs_apart_give_the_same_components(spark):
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 60)] + [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(500 + k, 501 + k) for k in range(30)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(df, most=5).collect())) == sorted(map(tuple, components(df).collect()))


def test_a_task_that_encodes_nothing_frees_the_encoder_of_one_before():
    from siltstone.llm import bpe

    bpe.encoder("word_bpe_49k.json", 10)
    assert bpe.encoder.cache_info().currsize and not list(simhash._links(iter([])))
    assert not bpe.encoder.cache_info().currsize
