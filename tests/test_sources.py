import json
import struct

import pytest

from siltstone.sources import feed, media, sinks


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4(seconds=10, bytes_=4000):
    head = bytes(12) + struct.pack(">II", 1000, seconds * 1000) + bytes(80)
    return box(b"ftyp", b"M4A \0\0\0\0") + box(b"moov", box(b"mvhd", head)) + box(b"mdat", bytes(bytes_))


def wav(seconds=1, declared=None):
    data = bytes(16000 * seconds)
    size = len(data) if declared is None else declared
    return b"RIFF" + struct.pack("<I", 36 + len(data) if declared is None else declared) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", size) + data


def mp3(frames=50):
    return (b"\xff\xfb\x90\x00" + bytes(413)) * frames


def test_whole_and_cut_media():
    p = media.probe_bytes
    assert p(mp4())["duration_s"] == 10 and not p(mp4())["truncated"]
    assert p(mp4()[:-100])["truncated"] and p(mp4(seconds=4000, bytes_=100))["reason"] == "too few bytes for the duration"
    assert p(box(b"ftyp", b"M4A \0\0\0\0"))["truncated"]
    assert p(wav())["duration_s"] == 1.0 and p(wav()[:-500])["truncated"] and not p(wav(declared=0xFFFFFFFF))["truncated"]
    assert abs(p(mp3())["duration_s"] - 50 * 1152 / 44100) < 1e-9 and p(mp3()[:-7])["truncated"] and p(b"ID3")["truncated"]
    assert p(b"", "x.ogg") == {"container": "ogg", "duration_s": None, "truncated": True, "reason": "empty", "size_bytes": 0}
    assert media.sniff(b"OggS....") == "ogg" and media.sniff(b"zzzz", "a.FLAC") == "flac" and media.sniff(b"zzzz", "a") == "unknown"


def test_probe_as_a_source(spark, tmp_path):
    for name, data in (("a.m4a", mp4()), ("b.wav", wav()), ("c.mp3", mp3())):
        (tmp_path / name).write_bytes(data)
    got = {r.container: r.truncated for r in media.probed(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"m4a": False, "wav": False, "mp3": False}
    assert feed.directory_size(spark, str(tmp_path)).first().files == 3


def test_pieces_tile():
    got = media.pieces(100.0, 30.0)
    assert got[0][0] == 0 and got[-1][1] == 100.0 and all(b[0] <= a[1] for a, b in zip(got, got[1:], strict=False)) and all(e - s <= 32.5 for s, e in got)


def item(k, **more):
    return {"id": f"i{k}", "name": f"{k}.m4a", "size": 10 + k, "cTag": "c", "file": {"mimeType": "audio/mp4", "hashes": {"quickXorHash": f"q{k}"}}, "parentReference": {"id": "p"}, "lastModifiedDateTime": "2024-01-01T00:00:00Z"} | more


def write_page(path, n, items):
    (path / f"page{n}.json").write_text(json.dumps({"items": items, "cursor": f"c{n}", "is_final": True}))


def test_feed_stream_is_exactly_once(spark, tmp_path):
    from siltstone.streaming.ingest import current, ingest

    src, log, state = tmp_path / "feed", str(tmp_path / "log"), str(tmp_path / "state")
    src.mkdir()
    write_page(src, 1, [item(1), item(2), item(3, folder={"childCount": 1}, file=None), {"name": "no id"}])
    ingest(feed.stream(spark, str(src)), log, "r", state).awaitTermination()
    write_page(src, 2, [item(2, deleted={"state": "x"}), item(1, file={"mimeType": "audio/mp4", "hashes": {"sha256Hash": "s1"}})])
    for _ in range(2):  # the second run finds nothing new
        ingest(feed.stream(spark, str(src)), log, "r", state).awaitTermination()
    schema = feed.scan(spark, str(src)).schema
    rows = sinks.read_batches(spark, log, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema))
    assert rows.count() == 4
    now = {r.item_id: r for r in current(rows).collect()}
    assert now["i1"].hash == "s1" and now["i1"].seen_count == 2 and now["i2"].deleted_in == 1 and now["i2"].hash == "q2" and now["i1"].deleted_in is None


def log_schema(spark, src):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in feed.scan(spark, str(src)).schema)


def test_a_moved_or_reset_cursor_loses_nothing(spark, tmp_path):
    """Two source folders, a resync of the second, and a replay: the log is appended to and never overwritten."""
    from siltstone.streaming.ingest import current, ingest

    one, two, log, base = tmp_path / "one", tmp_path / "two", str(tmp_path / "log"), str(tmp_path / "state")
    one.mkdir(), two.mkdir()
    cursors = feed.Cursors(spark, base)
    write_page(one, 1, [item(1), item(2)])
    write_page(two, 1, [item(7), item(1, file={"mimeType": "audio/mp4", "hashes": {"sha256Hash": "new"}})])
    for src in (one, two, two):  # the last run is a replay that finds nothing new
        ingest(feed.stream(spark, str(src)), log, "r", cursors.of("r", str(src))).awaitTermination()
    ids = lambda: sorted(r.item_id for r in sinks.read_batches(spark, log, log_schema(spark, one)).collect())
    assert ids() == ["i1", "i1", "i2", "i7"]
    with pytest.raises(ValueError):
        cursors.reset("r", str(two), " ")
    before = cursors.of("r", str(two))
    after = cursors.reset("r", str(two), "listing was incomplete")
    assert after != before and cursors.of("r", str(two)) == after and cursors.of("r", str(one)) != after
    assert cursors.reasons("r", str(two)) == ["listing was incomplete"]
    write_page(two, 2, [item(7, deleted={"state": "x"})])
    ingest(feed.stream(spark, str(two)), log, "r", after).awaitTermination()
    assert ids() == ["i1", "i1", "i1", "i2", "i7", "i7", "i7"]
    rows = sinks.read_batches(spark, log, log_schema(spark, one))
    now = {r.item_id: r for r in current(rows).collect()}
    # batch 0 of the second folder is later than batch 0 of the first, whatever their numbers
    assert now["i1"].hash == "new" and now["i1"].seen_count == 3 and now["i7"].deleted_in is not None and now["i2"].deleted_in is None
    assert rows.select("cursor").distinct().count() == 3


def test_a_torn_checkpoint_is_left_behind(spark, tmp_path):
    src, log, base = tmp_path / "feed", str(tmp_path / "log"), str(tmp_path / "state")
    src.mkdir()
    write_page(src, 1, [item(1), item(2)])
    cursors = feed.Cursors(spark, base)
    run = lambda: feed.poll(spark, {"r": feed.stream(spark, str(src))}, lambda b, n, route: sinks.append_batch(b, log, route, n), {"r": cursors.of("r", "s")}, lambda route, why: cursors.reset(route, "s", why))
    assert run() == {}
    (tmp_path / "state" / "delta" / "r").joinpath(cursors.of("r", "s").rsplit("/", 1)[1], "offsets", "0").write_text("torn")
    for crc in (tmp_path / "state").rglob(".0.crc"):
        crc.unlink()
    write_page(src, 2, [item(3)])
    assert run() == {} and len(cursors.reasons("r", "s")) == 1
    ids = [r.item_id for r in sinks.read_batches(spark, log, log_schema(spark, src)).collect()]
    assert sorted(ids) == ["i1", "i1", "i2", "i2", "i3"]  # read anew from the beginning, beside what was there


def test_failed_batch_is_replayed_without_doubles(spark, tmp_path):
    import pytest

    src, log, state = tmp_path / "feed", str(tmp_path / "log"), str(tmp_path / "state")
    src.mkdir()
    write_page(src, 1, [item(1), item(2)])
    fail = [True]

    def handle(batch, n, route):
        sinks.append_batch(batch, log, route, n)
        if fail[0]:
            raise RuntimeError("between rows and cursor")

    run = lambda: feed.poll(spark, {"r": feed.stream(spark, str(src))}, handle, {"r": state})
    assert "r" in run()
    fail[0] = False
    assert run() == {}
    assert spark.read.parquet(log).count() == 2
    with pytest.raises(ValueError):
        sinks.envelopes(spark.range(1))


def test_publishing_all_or_nothing(spark, tmp_path):
    import pytest

    files = spark.createDataFrame([("a.md", "x"), ("b.md", "y"), ("c.md", "z")], "name string, data string")
    sinks.publish(files, str(tmp_path / "out"))
    sinks.publish(files, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    with pytest.raises(ValueError):
        sinks.publish(files.limit(2), str(tmp_path / "out2"))
    assert not (tmp_path / "out2").exists() and not (tmp_path / "out2.staged").exists()


def test_status_files_and_books(spark, tmp_path):
    (tmp_path / "status-a.json").write_text(json.dumps({"instance": "b", "written_at": "2024-01-01T00:00:00Z", "done": 3}))
    (tmp_path / "status-b.json").write_text("{broken")
    (tmp_path / "status-c.json").write_text(json.dumps({"instance": "A", "done": 1}))
    got = feed.statuses(spark, str(tmp_path / "status-*.json"), "2024-01-01T10:00:00Z").collect()
    assert [(r.instance, r.silent) for r in got] == [("A", True), ("b", False)] and got[1].hours_old == 10
    (tmp_path / "book.json").write_text(json.dumps({"vocab_contract": 1, "sites": {"s": {"title": "T"}}}))
    assert feed.site_book(spark, str(tmp_path / "book.json")).first().title == "T" and feed.site_book(spark, str(tmp_path / "book.json"), 2).count() == 0


def test_rendering(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.lit(1).alias("item_id"), F.lit("s").alias("stem"), F.lit("roof").alias("subject"), F.lit("2024-01-01 10:00:00").cast("timestamp").alias("at"), F.lit("body").alias("body"), F.array(F.lit("one")).alias("summary"), F.array(F.struct(F.lit("Carel").alias("owner"), F.lit("fix it").alias("what"))).alias("actions"))
    got = {r.name: r.data for r in sinks.rendered(df).collect()}
    assert set(got) == {"s.md", "_s-summary.md", "_s-actions.md"} and got["s.md"].endswith("\n\nbody") and "Carel is reported as saying they would fix it" in got["_s-actions.md"]
