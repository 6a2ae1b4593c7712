from pyspark.sql import functions as F

from siltstone.operators import ledger as L
from siltstone.streaming import ingest as I


def ask(spark, rows):
    return spark.createDataFrame([(1, k, float(t), w, v, 10.0) for k, (t, w, v) in enumerate(rows)], "item_id long, seq long, at double, owner string, verb string, lease_s double")


def test_leases_to_the_second(spark):
    rows = [(0, "a", "claim"), (9, "b", "claim"), (10, "b", "claim"), (12, "a", "renew"), (15, "b", "fail"), (16, "a", "claim"), (45, "a", "claim"), (46, "a", "complete"), (99, "b", "claim"), (100, "x", "requeue"), (101, "b", "claim")]
    got = [r.granted for r in I.leases(ask(spark, rows)).orderBy("at").collect()]
    # b's claim at the very moment a's lease ends succeeds; a failed item waits 30 s; what is complete stays so until it is requeued
    assert got == [True, False, True, False, True, False, True, True, False, True, True]


def test_five_failures_end_it(spark):
    rows = [x for k in range(6) for x in ((k * 10_000, "a", "claim"), (k * 10_000 + 1, "a", "fail"))]
    got = I.leases(ask(spark, rows)).orderBy("at").collect()
    assert [r.granted for r in got] == [True] * 10 + [False] * 2


def test_stream_and_batch_agree(spark):
    from siltstone.plans.stream_queries import lease_claims, stream_lease_claims

    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(lease_claims(spark, "/root/testdata/sf0.001")) == key(stream_lease_claims(spark, "/root/testdata/sf0.001"))


def test_transitions(spark):
    rows = [(1, 1, "DONE", "advanced"), (1, 2, "CLAIMED", "claimed"), (1, 3, "DISCOVERED", "requeued"), (2, 1, "ERASED", "erased"), (2, 2, "DISCOVERED", "requeued")]
    df = spark.createDataFrame(rows, "item_id long, id long, to_state string, kind string")
    assert {r.item_id: (r.state, r.refused) for r in L.transitions(df).collect()} == {1: ("DISCOVERED", 1), 2: ("ERASED", 1)}


def test_folding_twice_changes_nothing(spark):
    df = spark.createDataFrame([(1, 1, "t1", "a", "x"), (1, 2, "t2", None, "y")], "item_id long, id long, moment string, first string, last string")
    fold = lambda d: L.upsert_fold(d.dropDuplicates(["item_id", "id"]), "item_id", ["moment", "id"], ["first"], ["last"]).collect()
    assert fold(df) == fold(df.unionByName(df)) and fold(df)[0].last == "y"


def test_holds_decisions_and_erasure(spark):
    spans = spark.createDataFrame([(1, 0, 5, "t", "2024-01-01", "shadow"), (1, 0, 5, "t", "2024-01-02", "on")], "item_id long, start int, end int, text string, at string, mode string")
    h = I.held_once(spans, armed=False).collect()
    assert len(h) == 1 and h[0].times_seen == 2 and h[0].mode == "on" and h[0].held_at == "2024-01-01"
    a = spark.createDataFrame([("h", "1", "RELEASED", "p", False, False), ("h", "2", "REFUSED", "q", False, False), ("h", "3", "REFUSED", "q", True, True), ("h", "4", "REFUSED", "", True, False)], "hold_id string, at string, decision string, by string, supersede boolean, undone boolean")
    assert I.decided(a).first().decision == "RELEASED"
    log = spark.createDataFrame([(1, "x"), (2, "y")], "item_id long, detail string")
    once = I.erased(log, log.where("item_id = 1"), ("detail",))
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, I.erased(once, log.where("item_id = 1"), ("detail",)).collect())) == [(1, None), (2, "y")]


def test_dates_alone_select_nothing(spark):
    import pytest

    with pytest.raises(ValueError):
        L.selection(spark.range(1), first="2024-01-01")


def test_sql_functions(spark):
    I.sql_functions(spark)
    assert spark.sql("select normalise('A  “b”') as x").first().x == 'a "b"'
    assert spark.sql("select * from split_pieces(100D, 40D)").count() == 3
    assert spark.range(1).select(F.lit(1)).count() == 1
