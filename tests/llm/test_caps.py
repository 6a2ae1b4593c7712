"""Operator 4 by brute force, and the pipeline's stages one by one."""


import numpy as np
import pytest
from conftest import SMALL

from siltstone.llm import capdedup


def slow(vectors):
    """vec_id -> links and component, over all pairs."""
    ok = [(i, e) for i, (_, e, lab) in enumerate(vectors) if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, root = [0] * len(vectors), list(range(len(vectors)))
    for p, (i, a) in enumerate(ok):
        for j, b in ok[:p]:
            if vectors[i][2] == vectors[j][2] and len(a) == len(b) and (list(a) == list(b) or np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93):
                links[i] += 1
                links[j] += 1
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, vectors[k][0]), vectors[k][0])
    return sorted((v[0], n, least[r], v[0] == least[r]) for v, n, r in zip(vectors, links, root, strict=True))


def sample(seed, n=260, dim=64, tight=0.02):
    rng = np.random.default_rng(seed)
    out = []
    centres = rng.normal(size=(8, dim))
    for k in range(n):
        c = centres[k % 8] if k % 3 else rng.normal(size=dim)
        e = [float(x) for x in np.float32(c + rng.normal(size=dim) * (0.05 if k % 7 else 0.4))]
        out.append((k, e, int(k % 8) % 3))
    return out


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_components(spark, seed):
    v = sample(seed)
    v += [(900 + k, v[k][1], v[k][2]) for k in range(5)] * 1 + [(910, [2 * x for x in v[0][1]], v[0][2])]
    v += [(920, None, 1), (921, [], 1), (922, [0.0] * 64, 1), (923, [float("nan")] * 64, 1), (924, [float("inf")] + [1.0] * 63, 1), (925, [None] + [1.0] * 63, 1), (926, v[0][1], None), (927, [1.0, 2.0], 0), (928, [2.0, 4.0], 0)]
    got = sorted(map(tuple, capdedup.near_duplicates(spark.createDataFrame(v, SCHEMA)).collect()))
    want = slow(v)
    assert [g[0] for g in got] == [w[0] for w in want]
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there * 0.99 <= found <= there and sum(g == w for g, w in zip(got, want, strict=True)) >= 0.98 * len(want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert got[-9:] == want[-9:]  # the unusable rows


def test_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    v = [(1000 * d + k, [float(x) for x in np.float32(rng.normal(size=d))], k % 2) for d in (1, 2, 3, 8) for k in range(60)]
    got, want = sorted(map(tuple, capdedup.near_duplicates(spark.createDataFrame(v, SCHEMA)).collect())), slow(v)
    found, there = sum(g[1] for g in got), sum(w[1] for w in want)
    assert there * 0.99 <= found <= there and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def test_sifting_keeps_what_is_near_and_all_of_crowds(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(capdedup, "SPLIT", 50)
    rng = np.random.default_rng(6)
    rows, want = [], set()
    for f, n in enumerate([1, 2, 30, 120, 1, 51, 50, 3]):
        s = rng.integers(-(1 << 62), 1 << 62, size=(n, 2))
        s[1::7] = s[::7][: len(s[1::7])] ^ 5
        for k in range(n):
            near = n > 50 or any(j != k and int(s[j, 0] ^ s[k, 0] & (1 << 64) - 1).bit_count() + int(s[j, 1] ^ s[k, 1]).bit_count() <= capdedup.NEAR_SIGNS for j in range(n))
            rows.append(("a" if f < 4 else "b", f, 1000 * f + k, k, int(s[k, 0]), int(s[k, 1])))
            want |= {1000 * f + k} if near else set()
    names = ["label_key", "filter", "rep", "nth", "s0", "s1"]
    for step in (7, 33, 400):
        batches = [pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows[i : i + step], strict=True)), strict=True))) for i in range(0, len(rows), step)]
        got = [r for b in capdedup._sift(iter(batches)) for r in b.column("rep").to_pylist()]
        assert sorted(got) == sorted(want)


def test_no_vectors(spark):
    assert capdedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = capdedup.near_duplicates(spark.createDataFrame([(1, None, None)], SCHEMA)).collect()
    assert list(map(tuple, one)) == [(1, 0, 1, True)]


def test_split_filters_count_like_whole_ones(spark, monkeypatch):
    v = sample(3, n=120)
    whole = sorted(map(tuple, capdedup.near_duplicates(spark.createDataFrame(v, SCHEMA)).collect()))
    monkeypatch.setattr(capdedup, "SPLIT", 7)
    assert sorted(map(tuple, capdedup.near_duplicates(spark.createDataFrame(v, SCHEMA)).collect())) == whole


def test_decoding_lists_all_exceeding_filters():
    f = capdedup.Filters(64, 2, 60, 0.3)
    assert abs(capdedup.cap_share(0.0, 64) - 0.5) < 1e-3 and capdedup.Filters.design(64, 10**9).blocks > 2
    turn, codes = f.tables()
    x = np.random.default_rng(0).normal(size=(20, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    row, name = f.decode(x, turn, codes)
    directions = np.concatenate([np.repeat(codes[0], f.words, 0), np.tile(codes[1], (f.words, 1))], 1)
    assert np.allclose(np.linalg.norm(directions, axis=1), 1)
    want = np.nonzero((x @ turn) @ directions.T >= f.height)
    assert sorted(zip(row.tolist(), name.tolist(), strict=True)) == sorted(zip(*(w.tolist() for w in want), strict=True))


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from siltstone.llm import mixing, secrets, simhash, toxicity
    from siltstone.session import table

    names = [n for n, _ in P.STAGES]
    assert len(names) == 5
    docs = table(spark, SMALL, "documents")
    seen, cols = docs, docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, seen, SMALL).cache()
        if k < 4:
            assert out.columns == cols
        before, after = {r.doc_id for r in seen.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after <= before
        if k == 0:
            verdict = {r.doc_id: r.predicted for r in toxicity.classified(seen, table(spark, SMALL, "labels")).collect()}
            assert after == {i for i in before if not verdict[i]}
        if k == 1:
            assert after == {r.component_id for r in simhash.near_duplicates(seen).collect()}
        if k == 2:
            assert after == before and secrets.scan(out).where("size(spans) > 0").count() == 0
        if k == 3:
            taken = {r.doc_id: r.taken for r in mixing.mix(seen).collect()}
            got = {}
            for r in out.collect():
                got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
            assert got == {i: n for i, n in taken.items() if n}
        if k == 4:
            assert after == before
        seen = out

