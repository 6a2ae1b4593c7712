import random

from pyspark.sql import functions as F

from siltstone.operators import windows as W


def test_islands_and_difference_by_points(spark):
    rng = random.Random(3)
    a = [(k, s := rng.randint(0, 200), s + rng.randint(1, 20)) for k in range(4) for _ in range(12)]
    b = [(k, s := rng.randint(0, 200), s + rng.randint(1, 30)) for k in range(4) for _ in range(4)]
    mk = lambda x: spark.createDataFrame(x, "k int, start int, end int")
    points = lambda x: {(k, p) for k, s, e in x for p in range(s, e)}
    union = [(r.k, r.start, r.end) for r in W.islands(mk(a), ["k"], "start", "end").collect()]
    assert points(union) == points(a) and len({(k, s) for k, s, _ in union}) == len(union)
    left = [(r.k, r.start, r.end) for r in W.subtract(mk(a), mk(b), ["k"], least=1).collect()]
    assert points(left) == points(a) - points(b)
    assert W.subtract(mk(a), mk(a), ["k"]).count() == 0 and W.subtract(mk([]), mk(b), ["k"]).count() == 0


def test_segments_end_at_speaker_pause_and_length(spark):
    words = [(1, 0.0, 0.3, "a", "hello"), (1, 0.4, 0.7, "a", "you"), (1, 2.0, 2.3, "a", "late"), (1, 2.4, 2.6, "b", "yes"), (1, 2.7, 2.9, "b", "x" * 400), (1, 3.0, 3.1, "b", "next")]
    df = spark.createDataFrame(words, "k int, start double, end double, speaker string, text string")
    got = [(r.start, r.end, r.speaker, len(r.text)) for r in W.segments(df, ["k"]).orderBy("segment").collect()]
    assert got == [(0.0, 0.7, "a", 9), (2.0, 2.3, "a", 4), (2.4, 2.9, "b", 404), (3.0, 3.1, "b", 4)]
    assert W.sessions(df, ["k"], 0.9).count() == 3


def greedy(sizes, budget, factor, margin):
    out, used, full = [], 0, False
    for s in sizes:
        need = -(-int(s * factor * 10) // 10) + margin if factor != 1 else s + margin
        if full:
            out.append("held")
        elif need > budget:
            out.append("refused")
        elif used + need > budget:
            full = True
            out.append("held")
        else:
            used += need
            out.append("admitted")
    return out


def test_admission_equals_the_greedy_scan(spark):
    rng = random.Random(5)
    for budget in (0, 50, 400):
        sizes = [rng.randint(1, 90) for _ in range(40)]
        df = spark.createDataFrame([(0, k, s) for k, s in enumerate(sizes)], "r int, k int, s long")
        got = [x.verdict for x in W.admission(df, ["r"], ["k"], "k", "s", budget, 1, 3).orderBy("k").collect()]
        assert got == greedy(sizes, budget, 1, 3)


def test_word_overlap(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["b", "c", "d"]), (["a"], ["b"]), ([], ["a"])], "l array<string>, r array<string>")
    assert [x.n for x in df.select(W.longest_overlap(F.col("l"), F.col("r")).alias("n")).collect()] == [2, 0, 0]


def test_opening_with_and_without_clocks(spark):
    df = spark.createDataFrame([(1, 0, 5.0, "a"), (1, 1, None, "b"), (1, 2, 61.0, "c"), (2, 0, None, "x" * 950), (2, 1, None, "y")], "k int, line int, at double, text string")
    assert sorted((r.k, r.line) for r in W.opening(df, ["k"]).collect()) == [(1, 0), (1, 1), (2, 0)]


def test_interleave_takes_turns(spark):
    from siltstone.operators.ledger import interleave

    df = spark.createDataFrame([(k, r, f"{k:03d}") for k, r in enumerate("aaaaabbc")], "item_id int, route string, discovered_at string")
    order = lambda **kw: [x.item_id for x in interleave(df, 8, **kw).collect()]
    assert order() == [0, 5, 7, 1, 6, 2, 3, 4] and order(start=1)[:3] == [5, 7, 0] and order(slice_size=2)[:4] == [0, 1, 5, 6]


def test_islands_of_equal_intervals(spark):
    """repeats of an interval are in one island, whatever the order of the rows."""
    spans = [(1, 5, 5), (1, 5, 5), (1, 1, 3), (1, 7, 8), (1, 7, 8), (1, 8, 8), (1, 8, 8), (1, 1, 3)]
    for rows in (spans, spans[::-1]):
        got = W.islands(spark.createDataFrame(rows, "k int, start int, end int").repartition(3), ["k"], "start", "end")
        assert sorted(map(tuple, got.select("start", "end", "n").collect())) == [(1, 3, 2), (5, 5, 2), (7, 8, 4)]


def test_islands_of_unknown_starts_and_ends_as_in_sql(spark):
    """null starts and ends come last, as DuckDB orders them."""
    import duckdb

    from siltstone.plans.window_queries import ISLANDS

    spans = [(1, 3, 5), (1, 3, None), (1, 4, 6), (1, None, None), (1, None, 9), (1, 8, 8), (2, None, None), (2, None, None), (None, 1, 2), (None, 2, None), (3, 5, None), (3, 7, 8)]
    got = W.islands(spark.createDataFrame(spans, "k int, start int, end int").repartition(3), ["k"], "start", "end").select("k", "start", "end", "n")
    values = ", ".join(str(s).replace("None", "null") for s in spans)
    want = duckdb.sql(f'with spans as (select * from (values {values}) t(k, start, "end")), {ISLANDS.format("spans")} select k, min(start), max("end"), count(*) from g group by k, g').fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
