"""Upkeep and answers: edges that the queries' SQL doesn't reach."""

import json
import random

import pytest
from pyspark.sql import functions as F

from siltstone.operators import answers as A
from siltstone.operators import upkeep as U
from siltstone.sources import sinks


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_protected_and_unknown_columns_are_refused(spark):
    items = frame(spark, "item_id long, state string, route string, name string", (1, "DONE", "a", "x"), (2, "ERASED", "a", "y"))
    for c in ("state", "route", "nowhere"):
        with pytest.raises(ValueError, match=c):
            U.patched(items, items, [c])
    patches = frame(spark, "item_id long, id long, name string", (1, 2, None), (1, 1, "new"), (2, 3, "gone"), (9, 4, "z"))
    assert {r.item_id: r.name for r in U.patched(items, patches, ["name"]).collect()} == {1: "new", 2: "y"}
    assert [r.item_id for r in U.orphans(patches, items).collect()] == [9]


def test_routes_when_none_is_asked_for(spark):
    routes = frame(spark, "route string, enabled boolean", ("a", True), ("b", False), ("c", None))
    chosen, problems = U.selected_routes(routes)
    assert {r.route for r in chosen.collect()} == {"a", "c"} and problems.count() == 0
    chosen, problems = U.selected_routes(routes.where("route = 'b'"))
    assert chosen.count() == 0 and problems.first().problem == "no route is on"


def test_queue_of_an_empty_ledger(spark):
    items = frame(spark, "item_id long, state string, discovered_at string")
    mornings = frame(spark, "day string, queued long")
    r = U.queue_state(items, mornings, "2024-01-01", "2024-01-01T00:00:00Z").first()
    assert (r.queued, r.previous, r.stale, r.growing, r.growing_across_days, r.short_of_throughput) == (0, None, False, False, False, False)
    r = U.group_totals(frame(spark, "hours_old double, arrived int, done int, failed int, month_usd double, day_usd double, unpriced boolean")).first()
    assert (r.peers, r.arrived, r.any_unpriced) == (0, 0, False)


def bucket(times, rate, burst):
    """A bucket that is stepped: full at first, a token a call, refilled as time goes on."""
    out, now, tokens = [], None, float(burst)
    for t in times:
        start = t if now is None else max(t, now)
        tokens = min(burst, tokens + (start - now) * rate) if now is not None else tokens
        if tokens < 1 - 1e-9:
            start, tokens = start + (1 - tokens) / rate, 1.0
        tokens, now = tokens - 1, start
        out.append(round(start, 4))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_pacing_is_a_token_bucket(spark, seed):
    r = random.Random(seed)
    times, burst, per_minute = sorted(round(r.random() * r.choice((5, 60)), 2) for _ in range(60)), r.randint(1, 6), r.choice((20, 60, 120))
    df = U.paced(frame(spark, "k int, id int, at double", *((0, i, t) for i, t in enumerate(times))), ["k"], per_minute, burst)
    assert [round(x.starts, 4) for x in df.orderBy("id").collect()] == pytest.approx(bucket(times, per_minute / 60, burst), abs=1e-3)


def test_a_release_is_written_once(spark, tmp_path):
    files = frame(spark, "item_id long, ref string, name string, data string", (1, "A", "n", "x"), (1, "B", "m", "y"), (1, "A", "n", "x"))
    path = f"file://{tmp_path}/released"
    assert [sinks.release_once(files.where("ref = 'A'"), path), sinks.release_once(files, path), sinks.release_once(files, path)] == [1, 1, 0]
    assert spark.read.parquet(path).count() == 2


BODY = {
    "summary_en": "s", "participants": [{"name_or_role": "Ann ann@x.example", "quote": "the wall is dry"}, {"name_or_role": "", "quote": "the wall"}, {"name_or_role": "Bo", "quote": "never said at all"}],
    "site": {"name": "", "quote": ""}, "commitments": [{"owner": "Ann", "what": "paint it..", "by_when": "", "quote": "We will paint it", "confidence": 3}], "decisions": [{"summary": "dry", "quote": "", "confidence": None}],
    "unclear_passages": [{"passage": "the wall is dry", "why": "noise"}, {"passage": " ", "why": ""}, {"passage": "zq", "why": "x"}],
}


def test_entries_of_an_answer(spark):
    texts = frame(spark, "item_id int, text string", (1, "The wall  is dry. We will paint it tomorrow."), (2, "x"), (3, None))
    read = A.read_answers(frame(spark, "item_id int, body string", (1, json.dumps(BODY)), (2, "[]"), (3, None)), sensitive=True)
    assert {r.item_id: len(r.lacking) for r in read.collect()} == {1: 9 + 6 - 6, 2: 15, 3: 15} | {1: len(set((*A.REQUIRED, "sensitive_passages")) - set(BODY))}
    got = [(r.category, r.summary, r.quote, r.kind, r.reason, r.confidence) for r in A.assembled(texts, read).orderBy("place").collect()]
    assert got == [
        ("participants", "Ann [address removed]", "The wall  is dry", "proposal", None, 0.0), ("participants", "Bo", "never said at all", "review", "the words are not in the text", 0.0),
        ("decisions", "dry", "", "review", "no quote", 0.0), ("commitments", "Ann is reported as undertaking: paint it", "We will paint it", "proposal", None, 1.0),
    ]
    assert [(r.passage, r.found) for r in A.unclear(texts, read).collect()] == [("the wall is dry", True), ("zq", False)]


def test_held_words_leave_records(spark):
    held = "he has been on a written warning since March"
    spans = F.array(F.struct(F.lit(0).alias("start"), F.lit(held).alias("words"), F.lit("ABC123").alias("ref")))
    record = json.dumps({"a": [f"I heard {held}.", 3], "b": {"c": "nothing"}})
    got = spark.range(1).select(A.mask_record(F.lit(record), spans).alias("r"), A.swallowed_by(F.lit("on a Written warning"), spans).alias("s"), A.swallowed_by(F.lit("on a picnic"), spans).alias("n"), A.mask_record(F.lit(f"x {held}"), spans).alias("t")).first()
    assert json.loads(got.r) == {"a": ["I heard [held ABC123].", 3], "b": {"c": "nothing"}} and (got.s, got.n, got.t) == ("ABC123", None, "x [held ABC123]")
    none = spark.range(1).select(A.mask_record(F.lit(None).cast("string"), spans).alias("r"), A.harvestable(F.lit(None).cast("string")).alias("q")).first()
    assert none.r is None and none.q == ""


def test_vocabulary_and_declared_routes(spark):
    v = lambda terms, name, most=100: spark.range(1).select(A.vocabulary_sent(F.array(*map(F.lit, terms)) if terms else F.lit(None).cast("array<string>"), F.lit(name).cast("string"), most).alias("v")).first().v
    assert v([" Beam ", "beam", "", "a@b.example"], "Kok") == ["Kok", "Beam", "[address removed]"] and v(["a", "b", "c"], "C", 2) == ["C", "a", "b"] and v(["a", "b"], "B") == ["a", "b"] and v([], None) == []
    r = spark.range(1).select(A.declared_routes(F.lit("a, B,a,a,c-1")).alias("r"), A.declared_routes(F.lit(None).cast("string")).alias("n")).first()
    assert r.r.routes == ["a", "c-1"] and r.r.problems == ["not a slug: B", "declared twice: a"] and r.n.routes == [] and r.n.problems == ["no route is declared"]
