"""Operators 1 and 6 against the tokenizers library on whole texts."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe, packing, token_files

ODD = ["", " ", "a", "  two  spaces ", "tab\tand\nlines\n\n  x", "don't we'll it's", "x y  z w", "é ́a", "İstanbul ΣΑΣ ß", "<|endoftext|> <|startoftext|>a", "a\x1cb !\x1c?", "日本語 text 🙂", "...,,, a.b,c", "ª º µ", "word. Word, WORD", "\n \n", "foo\n  bar", "foo\n \nbar", "end   nbsp  ", "a" * 300, "1234 5 67", "$%&|<>"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_units_give_the_ids_of_the_whole_text(name):
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    enc = bpe.Encoder(public_tokenizers.path(name), limit=50)  # the cache starts anew all the time
    rng = random.Random(1)
    pieces = [*ODD, *" \n\t.,'!?-", "Éàü", "the", "of", "Thnt", "ÉÀÜ", "It's"]
    texts = ODD + ["".join(rng.choices(pieces, k=rng.randint(1, 12))) for _ in range(1500)]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    assert enc.encode(None) == b""


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part string")


ROWS = [(7, "later text", "x", "y"), (3, None, "x", None), (3, "", None, "y"), (5, "twice", "x", "y"), (5, "twice", "x", "y"), (1, "word " * 3000, "x", "y"), (None, "no id", "x", "y")]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = [tuple(r) for r in token_files.token_digest(docs_of(spark, ROWS)).orderBy("start").collect()]
    want, at = [], 0
    for doc_id, text, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert token_files.token_digest(docs_of(spark, [])).count() == 0


def test_rows_of_one_doc_id_go_to_many_files(spark, tmp_path):
    rows = [(None, f"text {k % 40} of many that begin alike, as all of these do", None, None) for k in range(2000)] + [(4, "equal", None, None)] * 2000
    path = str(tmp_path / "t")
    token_files.write_tokens(docs_of(spark, rows), path, files=8)
    got = token_files.read_tokens(spark, path, ("part", "doc_id")).groupBy("part").count().collect()
    assert sum(r["count"] for r in got) == 4000 and len(got) >= 6 and max(r["count"] for r in got) < 1500
    digest = token_files.token_digest(docs_of(spark, rows)).orderBy("start").collect()
    assert [r.doc_id for r in digest] == [None] * 2000 + [4] * 2000
    assert all(b.start == a.start + a.n_tokens for a, b in zip(digest, digest[1:], strict=False))


def test_packing_reads_nothing_else(spark):
    odd = docs_of(spark, ROWS).withColumns({c: F.lit("x") for c in ("length", "piece", "sequence_id", "offset", "local_rank")})
    assert packing.pack_documents(odd).count() == packing.pack_documents(docs_of(spark, ROWS)).count()


def test_token_files_are_selective(spark, tmp_path):
    import pyarrow.parquet as pq

    path = str(tmp_path / "t")
    token_files.write_tokens(docs_of(spark, [(k, f"text number {k}", None, None) for k in range(2000)]), path, files=2, row_group_bytes=1 << 20)
    assert token_files.read_tokens(spark, path, ("doc_id", "n_tokens"), 10, 19).count() == 10
    plan = token_files.read_tokens(spark, path, ("n_tokens",), 10, 19)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10)" in plan and "ids" not in plan.split("ReadSchema")[1]
    files = sorted((tmp_path / "t").glob("*.parquet"))
    last = -1
    for f in files:
        meta = pq.ParquetFile(f).metadata
        column = {meta.row_group(0).column(i).path_in_schema.split(".")[0]: meta.row_group(0).column(i) for i in range(meta.num_columns)}
        assert "DELTA_BINARY_PACKED" in column["doc_id"].encodings and "RLE_DICTIONARY" in column["ids"].encodings
        assert column["doc_id"].has_offset_index and column["doc_id"].has_column_index
        assert column["doc_id"].statistics.min > last
        last = column["doc_id"].statistics.max


def sequences(rows, capacity=1024):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_documents(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs_of(spark, ROWS)).collect()
    sequences(got)
    want = []
    for doc_id, text, *_ in ROWS:
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024 if len(ids) > 1024 else len(ids)
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want += [(doc_id, k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=key) == sorted(want, key=key)
    assert packing.pack_documents(docs_of(spark, [])).count() == 0


def filled(patterns, capacity):
    used = Counter()
    for n, content in patterns:
        assert n > 0 and 0 < sum(k * v for k, v in content.items()) <= capacity
        for k, v in content.items():
            used[k] += n * v
    return used, sum(n for n, _ in patterns)


def optimum(items, capacity):
    """Fewest sequences, by trying every way (small instances)."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k, room in enumerate(bins):
            if room >= items[i] and room not in bins[:k]:
                go(i + 1, [*bins[:k], room - items[i], *bins[k + 1 :]])
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    rng = random.Random(11)
    for _ in range(150):
        capacity = rng.choice([10, 12, 20])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        counts, plan = Counter(items), packing.Plan()
        packing.reduce_by_dominance(counts, capacity, plan)
        rest = [x for x, n in counts.items() for _ in range(n)]
        assert sum(n for n, _ in plan.patterns) + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity), (capacity, items)
        used, n = filled(packing.solve(Counter(items), capacity), capacity)
        assert used == Counter(items) and n <= optimum(items, capacity) * 11 / 9 + 1


def test_large_histograms_pack_near_the_bound():
    rng = random.Random(2)
    counts = Counter(min(1024, 1 + int(rng.expovariate(1 / 300))) for _ in range(200_000))
    patterns = packing.solve(counts, 1024)
    used, n = filled(patterns, 1024)
    assert used == counts and n <= 1.01 * -(-sum(k * v for k, v in counts.items()) // 1024)
    assert len(packing.runs(patterns)) < 20_000
