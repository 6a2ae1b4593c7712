from conftest import SMALL
from pyspark.sql import functions as F

from siltstone.functions import report as R
from siltstone.plans.reports import daily_report
from siltstone.sources.adapter import holds, items


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wording(spark):
    s = lambda *n: one(spark, R.subject(F.lit("d"), *map(F.lit, n)))
    assert s(0, 0, 0, 0) == "d: nothing arrived" and s(3, 3, 0, 0) == "d: all 3 done" and s(4, 2, 1, 1) == "d: 1 to look at; 2 of 4 done, 1 waiting"
    t = F.lit("2024-01-31 23:30:00").cast("timestamp")
    assert one(spark, R.friendly(t, "Africa/Johannesburg")) == "Thursday 1 February 2024, 01:30" and one(spark, R.typed_stamp(t)) == "310124 2330"
    assert one(spark, R.phrase_at(F.lit("At the  Blue house"), "blue house")) == 9 and one(spark, R.phrase_at(F.lit("blues house"), "blue")) == 0
    assert [one(spark, R.looks_like_address(F.lit(x))) for x in ("a@b.co", "see a@b.co", "x")] == [True, False, False]
    assert one(spark, R.routes_said(F.lit("route 'a-1' and route 'b'"))) == ["a-1", "b"] and one(spark, R.routes_said(F.lit("route 'a'"))) == []
    assert one(spark, R.digests(F.lit(b"x")))["sha1"] == "11f6ad8ec52a2984abaafd7c3b516503785c2072"


def test_contexts(spark):
    spans = F.array(F.struct(F.lit(2).alias("start"), F.lit(5).alias("end"), F.lit("R").alias("ref")), F.struct(F.lit(4).alias("start"), F.lit(7).alias("end"), F.lit("S").alias("ref")))
    assert one(spark, R.context(F.lit("0123456789"), F.lit(1), F.lit(9), spans)) == "1[held R][held S]78"
    seg = F.array(F.struct(F.lit(1.0).alias("start"), F.lit(2.0).alias("end"), F.lit("x").alias("text")))
    assert one(spark, R.shifted(seg, F.lit(10.0)))[0].start == 11.0


def test_daily_report(spark):
    text = daily_report(items(spark, SMALL), holds(spark, SMALL), "1996-05-05")
    assert text.startswith("Report of 1996-05-05") and "Waiting:" in text and "Held for a person:" in text
