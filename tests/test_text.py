import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("spelling", ["a.b@example.co.za", "a.b ＠ example.co.za", "a.b%40example.com", "a.b&#64;example.org", "A.B@EXAMPLE.COM"])
def test_addresses_in_any_spelling(spark, spelling):
    t = F.lit(f"write to {spelling} now")
    assert one(spark, T.contains_email(t)) and "example" not in one(spark, T.strip_emails(t)).lower()


@pytest.mark.parametrize("said,hit", [("carel at example dot co dot za", True), ("Carel, at example.co.za", True), ("look at the roof", False), ("at 3 dot 5 metres", False)])
def test_dictated_addresses(spark, said, hit):
    assert one(spark, T.contains_dictated(F.lit(said))) is hit


@pytest.mark.parametrize(
    "name,form,party,at,copy",
    [
        ("Call Carel_260420_133533.m4a", "call", "Carel", "2026-04-20 13:35:33", None), ("Call recording_260827_143005.m4a", "call-recording", None, "2026-08-27 14:30:05", None),
        ("Call recording Bob_260827_143005 (3).m4a", "call-recording", "Bob", "2026-08-27 14:30:05", 3), ("Voice 260806_162219.m4a", "free-text", None, "2026-08-06 16:22:19", None),
        ("Site walk.m4a", "free-text", None, None, None), ("Call X_260832_250000.m4a", "call", "X", None, None), ("", "free-text", None, None, None),
    ],
)
def test_file_names(spark, name, form, party, at, copy):
    p = one(spark, T.parsed_name(F.lit(name)))
    assert (p.form, p.party, str(p.at) if p.at else None, p.copy) == (form, party, at, copy)


def test_sizes_and_durations(spark):
    assert [one(spark, T.parse_bytes(F.lit(x))) for x in ("4GiB", "10 kb", "512", "x")] == [4 << 30, 10_000, 512, None]
    assert [one(spark, T.human_duration(F.lit(x))) for x in (1, 59, 60, 7200, 90000)] == ["1 second", "59 seconds", "1 minute", "2 hours", "1 day"]
    assert one(spark, T.clock(F.lit(3725.9))) == "01:02:05" and one(spark, T.clock(F.lit(-3))) == "00:00:00"


def test_identity_numbers(spark):
    def check_digit(d):
        return str(-sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(d[::-1])) % 10)

    body = "850101500908"
    good = body + check_digit(body)
    assert one(spark, T.is_identity_number(F.lit(good)))
    for bad in (good[:-1] + str((int(good[-1]) + 1) % 10), "8513" + good[4:], good[:10] + "5" + good[11:], good + "0", ""):
        assert not one(spark, T.is_identity_number(F.lit(bad)))


def test_back_off_and_jitter(spark):
    spans = [r.x for r in spark.range(1, 12).select(T.backoff("id").alias("x")).collect()]
    assert spans[:3] == [30, 60, 120] and spans[-1] == 3600
    r = spark.range(500).select(T.jittered(F.lit(3)).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert 60 <= r[0] and r[1] <= 120


def test_meta_merge_and_masks(spark):
    assert one(spark, T.merge_meta(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3"}'))) == {"a": "1", "b": "3"}
    assert one(spark, T.merge_meta(F.lit(None).cast("string"), F.lit("not json"))) == {}
    assert one(spark, T.mask_tail(F.lit("abcdefgh"))).endswith("efgh") and "d" not in one(spark, T.mask_tail(F.lit("abcd")))
    assert one(spark, T.scrub(F.lit("key abc and abcdef"), ["abc", "abcdef", ""])) == "key *** and ***"


def test_stems_and_stamps(spark):
    assert one(spark, T.safe_stem(F.lit("  Call a@b.co / re: roof?  "))) == "Call address-removed - re- roof"
    assert len(one(spark, T.safe_stem(F.lit("word " * 60)))) <= 120 and one(spark, T.safe_stem(F.lit("///"))) == "recording"
    assert one(spark, T.parse_stamp(F.lit("2024-01-02T03:04:05.1234567Z"))) == 1704164645 and one(spark, T.parse_stamp(F.lit("soon"))) is None
    assert one(spark, T.retry_after(F.lit("12"), F.current_timestamp())) == 12.0
    assert [one(spark, T.language(F.lit(x))) for x in ("en-ZA", "zu", "??")] == ["en", "zu", None] and one(spark, T.language3(F.lit("af-ZA"))) == "afr"
    assert one(spark, T.plain_reason(F.lit("HTTP 429"))) == "too many requests"


def test_restoring_and_refs(spark):
    t = F.lit("a [held ABCDEF] b [held 012345] c [held ABCDEF]")
    assert one(spark, T.refs_in(t)) == ["ABCDEF", "012345"]
    assert one(spark, T.restore(t, F.create_map(F.lit("ABCDEF"), F.lit("words")))) == "a words b [held 012345] c words"


def test_sizes_are_rounded_as_by_printf(spark):
    sizes = [1023, 1024, 1024 + 256, 1024 + 768, (5 << 20) + (1 << 18), (7 << 20) + (3 << 18), (9 << 30) + (1 << 28), (9 << 30) + (1 << 28) + 1, (1 << 20) - 1, (1 << 53) - 1]
    got = [one(spark, T.format_bytes(F.lit(x))) for x in sizes]
    assert got == ["1023 B", *(f"{x / 1024:.1f} KiB" for x in sizes[1:4]), "5.2 MiB", "7.8 MiB", "9.2 GiB", "9.3 GiB", "1024.0 KiB", "8388608.0 GiB"]
