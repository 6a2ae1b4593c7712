"""Joins on words: what is broadcast, and pairs that share words against all pairs."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.operators import entities as E
from siltstone.operators.joins import met
from siltstone.plans import catalog

DATA = "/root/testdata/sf0.01"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001


def test_binding_does_not_broadcast_exploded_words(spark):
    assert "Broadcast" not in plan(catalog.queries()["entity_bind_tie_null"](spark, DATA))


def test_mentions_do_not_broadcast_exploded_words(spark):
    assert "Broadcast" not in plan(catalog.queries()["mentions_max"](spark, DATA))


def test_ranking_does_not_broadcast_exploded_words(spark):
    assert "Broadcast" not in plan(catalog.queries()["entity_ranked"](spark, DATA))


def test_ranking_broadcasts_nothing_when_planned_anew(spark):
    """As it runs, Spark plans anew by the sizes that it meets: no small table goes through the driver then either."""
    df = catalog.queries()["entity_ranked"](spark, DATA)
    assert df.collect() and "isFinalPlan=true" in plan(df) and "Broadcast" not in plan(df)


def named(texts, sites):
    """D14 pair by pair, as its SQL counts: rows that share a key add up."""
    d, s = defaultdict(Counter), defaultdict(Counter)
    for out, rows in ((d, texts), (s, sites)):
        for key, said in rows:
            out[key].update(set(said.lower().split()))
    shared = {(k, n): sum(m * w[x] for x, m in t.items()) for k, w in d.items() for n, t in s.items()}
    return {(*k, v) for k, v in shared.items() if v and 2 * v >= s[k[1]].total()}


@pytest.mark.parametrize("rare,repeats", [(0, False), (3, False), (100, False), (3, True)])
def test_named_sites_against_all_pairs(spark, rare, repeats):
    rng = random.Random(7)
    said = lambda: " ".join(rng.choice("abcdefghij")[: 1 + rng.randrange(2)] + str(min(rng.randrange(9), rng.randrange(9))) for _ in range(rng.randrange(1, 9)))
    texts = [(k - (repeats and k % 5 == 1), said()) for k in range(60)]
    sites = [(f"s{k - (repeats and k % 7 == 1)}", said()) for k in range(50)]
    got = E.named_sites(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(sites, "site string, title string"), rare)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == named(texts, sites)


def test_named_sites_that_share_common_words_alone_do_not_meet(spark, monkeypatch):
    """500 titles and texts with two words in common: no pair is named, and none is made."""
    made = []
    monkeypatch.setattr(E, "met", lambda *a: made.append(met(*a)) or made[-1])
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("the site t"), "id").alias("text"))
    sites = spark.range(500).select(F.concat(F.lit("s"), "id").alias("site"), F.concat(F.lit("the site x"), "id", F.lit(" y"), "id", F.lit(" z"), "id").alias("title"))
    assert E.named_sites(texts, sites, 100).count() == 0 and [x.count() for x in made] == [0] * 3


def test_named_sites_compares_texts_of_the_same_words_as_one(spark, monkeypatch):
    """300 copies of a text and of a title, in another order of words, are all paired, but compared as a few."""
    made = []
    monkeypatch.setattr(E, "met", lambda *a: made.append(met(*a)) or made[-1])
    texts = spark.range(300).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"), F.concat(F.when(F.col("id") % 2 == 0, "red old ring in ").otherwise("in old ring red "), "id", F.lit("t")).alias("text"))
    sites = spark.range(300).select(F.concat(F.lit("s"), "id").alias("site"), F.when(F.col("id") % 2 == 0, "red ring old").otherwise("ring red old").alias("title"))
    rows = {tuple(r) for r in E.named_sites(texts, sites, 100).collect()}
    assert rows == {(k or None, f"s{j}", 3) for k in range(300) for j in range(300)}
    assert made[0].count() <= 3 * 10 * 10  # by each of three pairs of words
