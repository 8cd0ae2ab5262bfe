import bz2
import gzip
import json
import random
from types import SimpleNamespace

import pytest
import zstandard
from pyspark.sql import functions as F

from tallywire import Archive
from tallywire.functions.taxonomy import classify
from tallywire.session import shared_folder
from tallywire.sources import archive as source

from . import wire

FIRST = "node.a.b.20240101-000000-000.events.zst"
SECOND = "node.a.b.20240101-013000-250.json"


def as_json(row, n):
    full = {k: v for k, v in dict(row, record_no=n).items() if v is not None}
    return json.dumps(full, default=lambda b: "")


@pytest.fixture
def folder(tmp_path):
    """Two rotated files; the later one was written first and holds a damaged record."""
    one = [wire.message(5000, 1, "ping", False), wire.message(5100, 1, "pong", True)]
    two = [wire.message(4000, 1, "ping", False), wire.message(4100, 2, "inv", True)]
    lines = [as_json(r, i) for i, r in enumerate(two)]
    lines.insert(1, '{"ts_ms": 17, "arm"')
    (tmp_path / SECOND).write_text("\n".join(lines) + "\n")
    header = json.dumps({"created_s": 1704067200, "low_data": True})
    text = "\n".join([header, *(as_json(r, i) for i, r in enumerate(one))]) + "\n"
    (tmp_path / FIRST).write_bytes(zstandard.compress(text.encode()))
    (tmp_path / "node.a.b.20240101-020000-000.json").write_text("{broken\n")
    # Not compressed at all, whatever its name says.
    (tmp_path / "node.a.b.20240101-030000-000.events.zst").write_bytes(b"no zstandard frame")
    return str(tmp_path)


def test_file_time(spark):
    names = {
        FIRST: 1704067200000, SECOND: 1704072600250, "x.20240101-000000-001.bin": 1704067200001,
        "plain.zst": None, "x.20240101-0000.zst": None,
    }
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1] for r in df.select("n", source.file_time_ms(F.col("n"))).collect()}
    assert got == names
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        again = {r[0]: r[1] for r in df.select("n", source.file_time_ms(F.col("n"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert again == names


def test_files_read_as_one_archive(spark, folder):
    events = source.read_events(spark, folder, "json").orderBy("pos").collect()
    assert [(r.file_name, r.ts_ms, r.kind) for r in events] == [
        (FIRST, 5000, "ping"), (FIRST, 5100, "pong"), (SECOND, 4000, "ping"), (SECOND, 4100, "inv"),
    ]


def test_summary_counts_damage_per_file(spark, folder):
    archive = Archive.open(spark, folder, "json")
    files = {r.file_name: r for r in archive.file_summary().collect()}
    assert [(files[f].events, files[f].decode_errors, files[f].error) for f in (FIRST, SECOND)] == [
        (2, 0, None), (2, 1, None),
    ]
    assert (files[FIRST].created_s, files[FIRST].low_data) == (1704067200, True)
    assert (files[SECOND].created_s, files[SECOND].low_data) == (None, None)
    third = next(r for f, r in files.items() if "020000" in f)
    assert (third.events, third.decode_errors, third.error) == (0, 1, "no readable event")
    assert third.size_bytes == 8
    fourth = next(r for f, r in files.items() if "030000" in f)
    assert (fourth.events, fourth.decode_errors, fourth.error) == (0, 0, "not readable to its end")
    totals = wire.one(archive.totals())
    assert (totals.events, totals.decode_errors, totals.peers) == (4, 2, 2)


def test_parquet_round_trip(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [wire.inv(1000, 1, [1, 2]), wire.tx(1100, 1, 1, 9)]
    written = wire.archive(spark, rows)
    source.write_result(written.drop("pos").coalesce(1), path)
    back = source.read_events(spark, path)
    assert wire.rows(back, "ts_ms", "kind", "items") == wire.rows(written, "ts_ms", "kind", "items")
    numbered = source.with_record_no(spark, path)
    assert sorted(r.record_no for r in numbered.select("record_no").collect()) == [0, 1]
    texts = [json.loads(r.json) for r in source.result_json(back.select("pos", "kind")).collect()]
    assert {t["kind"] for t in texts} == {"inv", "tx"}


def test_unreadable_parquet_file_does_not_spoil_the_rest(spark, tmp_path):
    path = str(tmp_path / "mixed")
    source.write_result(wire.archive(spark, [wire.message(1, 1, "ping", True)]).drop("pos"), path)
    (tmp_path / "mixed" / "zzz.parquet").write_bytes(b"no parquet at all")
    archive = Archive.open(spark, path)
    assert wire.one(archive.totals()).events == 1
    broken = [r for r in archive.file_summary().collect() if r.file_name == "zzz.parquet"]
    assert [(r.events, r.error) for r in broken] == [(0, "not readable to its end")]


def test_equal_names_in_two_folders(spark, tmp_path):
    for folder, n in (("a", 2), ("b", 3)):
        (tmp_path / folder).mkdir()
        lines = [as_json(wire.message(100 * i, 1, "ping", True), i) for i in range(n)]
        (tmp_path / folder / "events.json").write_text("\n".join(lines) + "\n")
    archive = Archive.open(spark, [str(tmp_path / f) for f in "ab"], "json")
    rows = archive.events.collect()
    assert len({r.pos for r in rows}) == len(rows) == 5
    assert sorted((r.file_name, r.events) for r in archive.file_summary().collect()) == [
        ("events.json", 2), ("events.json", 3),
    ]


@pytest.mark.parametrize("name", ["my file.json", "a+b.json", "100%.json", "ü [1] {x}.json"])
def test_odd_file_names(spark, tmp_path, name):
    lines = [as_json(wire.message(100 * i, 1, "ping", True), i) for i in range(2)]
    (tmp_path / name).write_text("\n".join(lines) + "\n")
    archive = Archive.open(spark, str(tmp_path), "json")
    assert [r.file_name for r in archive.events.collect()] == [name] * 2
    assert [(r.file_name, r.events, r.error) for r in archive.file_summary().collect()] == [(name, 2, None)]


def test_every_line_is_an_event_a_header_or_bad(spark, tmp_path):
    lines = [
        as_json(wire.message(5, 1, "ping", True), 0), "{}", '{"foo":1}', '{"record_no":3,"arm":"rpc"}',
        '{"ts_ms":7,"arm":"rpc"}', "garbage", "17", "[1]", '"text"', "null", '{"created_s":1}', '{"ts_ms":"x"}',
        '{"ts_ms":9,"record_no":10,"arm":null}',
    ]
    (tmp_path / "f.json").write_text("\n".join(lines) + "\n\n  \n")
    raw = source.read_raw(spark, str(tmp_path), "json")
    good, bad = source.quarantine(raw)
    headers = raw.filter(source.is_header(raw)).count()
    assert (good.count(), headers, bad.count()) == (2, 1, len(lines) - 3)
    assert sorted(r[source.CORRUPT] for r in bad.collect()) == sorted(lines[1:10] + [lines[11]])
    archive = Archive.open(spark, str(tmp_path), "json")
    assert wire.one(archive.totals()).decode_errors == len(lines) - 3


def test_files_cut_in_the_middle(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    lines = [as_json(wire.message(i, i % 50, "ping", True), i) for i in range(60_000)]
    whole = gzip.compress("\n".join(lines).encode())
    (folder / "a.json.gz").write_bytes(whole)
    (folder / "b c.json.gz").write_bytes(whole[: len(whole) // 2])
    archive = Archive.open(spark, str(folder), "json")
    found = {r.file_name: r for r in archive.file_summary().collect()}
    assert (found["a.json.gz"].events, found["a.json.gz"].error) == (60_000, None)
    cut = found["b c.json.gz"]
    assert 0 < cut.events < 60_000 and cut.error == "not readable to its end"


def test_cut_parquet_and_missing_numbers(spark, tmp_path):
    path = tmp_path / "p"
    rows = wire.archive(spark, [wire.message(i, 1, "ping", True) for i in range(50)])
    source.write_result(rows.drop("pos", "record_no").coalesce(1), str(path))
    part = next(path.glob("part-*.parquet"))
    (path / "zcut.parquet").write_bytes(part.read_bytes()[:-100])
    archive = Archive.open(spark, str(path))
    assert sorted(r.pos for r in archive.events.collect()) == list(range(50))
    found = {r.file_name: (r.events, r.error) for r in archive.file_summary().collect()}
    assert found == {part.name: (50, None), "zcut.parquet": (0, "not readable to its end")}


def endings(tmp_path, body: bytes):
    """Files by name, and whether they can be read to their end."""
    two = gzip.compress(body) + gzip.compress(body)
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(body)
    files = {
        "a.gz": (two, True), "b.gz": (two[:-9], False), "c.gz": (b"", True), "d.gz": (two + b"x", False),
        "e.zst": (frame + frame, True), "f.zst": (frame[:-1], False), "g.zst": (frame[:99] + b"?" + frame[100:], False),
        "h.bz2": (bz2.compress(body), True), "i.bz2": (bz2.compress(body)[:-4], False), "j.json": (body[:-7], True),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    return {name for name, (_, sound) in files.items() if not sound}


def test_each_file_is_probed_for_its_own_end(spark, tmp_path):
    draw = random.Random(4)
    body = "\n".join(f'{{"ts_ms":{draw.getrandbits(60)},"record_no":{i}}}' for i in range(9000)).encode()
    want = endings(tmp_path, body)
    files = source.list_files(spark, str(tmp_path))
    found = source.damaged_files(spark, str(tmp_path), "json", files)
    assert {r[0].rsplit("/", 1)[1] for r in found.collect()} == want
    # Read by Spark alone, as files above the size are, damage in the middle is found as well.
    by_reading = source.damaged_files(spark, str(tmp_path), "json", files, probe_bytes=0)
    assert {r[0].rsplit("/", 1)[1] for r in by_reading.collect()} >= {"b.gz", "g.zst"}


def test_parquet_cut_or_overwritten(spark, tmp_path):
    spark.range(50_000).selectExpr("id", "uuid() AS u").coalesce(1).write.parquet(str(tmp_path / "one"))
    whole = next((tmp_path / "one").glob("*.parquet")).read_bytes()
    home = tmp_path / "all"
    home.mkdir()
    half = len(whole) // 2
    for name, data in {
        "a": whole, "b": whole[:half], "c": whole[:9] + b"\0" * 400 + whole[409:], "d": whole[:-4] + b"PARX",
    }.items():
        (home / f"{name}.parquet").write_bytes(data)
    files = source.list_files(spark, str(home))
    found = source.damaged_files(spark, str(home), "parquet", files)
    assert {r[0].rsplit("/", 1)[1][0] for r in found.collect()} == {"b", "c", "d"}


def test_a_lost_file_is_no_damage(spark, folder, tmp_path):
    assert source.is_damage("[FAILED_READ_FILE.NO_HINT] Encountered error while reading file x")
    assert not source.is_damage("[FAILED_READ_FILE.FILE_NOT_EXIST] File does not exist")
    assert not source.is_damage("Job aborted due to stage failure: ExecutorLostFailure")
    files = source.list_files(spark, folder)
    with pytest.raises(Exception, match="nowhere"):
        source.damaged_files(spark, str(tmp_path / "nowhere"), "json", files).collect()


def test_an_event_of_an_unlisted_file_is_an_error(spark, folder):
    good, _ = source.quarantine(source.read_raw(spark, folder, "json"))
    some = source.list_files(spark, folder).limit(1)
    with pytest.raises(Exception, match="not in the list of files"):
        source.with_archive_order(good, some).collect()


def test_strip(spark):
    raw = lambda n: [{"txid": b"t" * 32, "wtxid": b"w" * 32, "raw": b"x" * n}]
    rows = [
        wire.message(1, 1, "tx", True, txid=wire.hash32(1), wtxid=wire.hash32(1), raw=b"x" * 1000),
        wire.message(1, 1, "block", True, block_hash=wire.hash32(2), txs=raw(500)),
        wire.message(1, 1, "blocktxn", True, txs=raw(70) + raw(30)),
        wire.message(1, 1, "cmpctblock", True, txs=raw(11)),
        wire.message(1, 1, "mystery", True, payload=b"p" * 200),
        wire.message(1, 1, "tx", True, txid=wire.hash32(1)),
        wire.inv(1, 1, [1]),
    ]
    stripped, stats = source.strip_payloads(wire.archive(spark, rows))
    assert tuple(wire.one(stats)) == (5, 1000 + 500 + 64 + 100 + 11 + 200)
    kept = {r.kind: r for r in stripped.collect()}
    assert "raw" not in stripped.columns and "payload" not in stripped.columns
    assert kept["block"].txs is None and kept["block"].block_hash == bytearray(wire.hash32(2))
    assert [t.asDict() for t in kept["blocktxn"].txs] == [{"txid": b"t" * 32, "wtxid": b"w" * 32}] * 2


def session_with(master, **conf):
    """Just what the folder choice looks at; the real setting cannot change while Spark runs."""
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: conf.get(key.replace(".", "_"), default)),
        sparkContext=SimpleNamespace(master=master),
    )


def test_shared_folder(spark):
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    given = session_with("spark://host:7077", spark_checkpoint_dir="/shared/place")
    assert shared_folder(given, "x").startswith("/shared/place/x-")
    with pytest.raises(ValueError):
        shared_folder(session_with("spark://host:7077"), "x")


def test_every_question(spark):
    """The whole surface on one small archive."""
    rows = [
        wire.opened(900, 3), wire.version(950, 3, "/a/"), wire.inv(1000, 3, [1]), wire.inv(1100, 4, [1]),
        wire.naming(1200, 3, "getdata", False, 37, [1]), wire.tx(1300, 3, 1, 400), wire.tx(1400, 4, 1, 400),
        wire.naming(2000, 3, "ping", False, 8, [7]), wire.naming(2120, 3, "pong", True, 8, [7]),
        wire.ended(5000, 4, "inbound", 2), wire.poll(6000, [(4, "/b/")]),
    ]
    a = Archive(wire.archive(spark, rows))
    assert wire.one(a.totals()).events == 11
    assert a.breakdown().count() == 9
    assert a.timeline(10).groupBy().sum("cnt").first()[0] == 11
    assert a.timeline_group("message", 10).groupBy().sum("cnt").first()[0] == 8
    assert [r.event_group for r in a.groups_present().collect()] == ["message", "connection", "rpc"]
    assert [(r.peer_id, r.user_agent) for r in a.peers().collect()] == [(3, "/a/"), (4, "/b/")]
    detail = wire.one(a.peer_detail(3))
    assert (detail.user_agent, detail.relay.first, detail.relay.delivered) == ("/a/", 1, 1)
    assert a.query(0, 3, kinds=["inv"]).count() == 2
    assert wire.one(a.query_total(text="10.0.0.4")).total == 3
    assert [r.request_row for r in a.sequence().filter("request_row is not null").orderBy("row").collect()] == [2, 4, 7]
    assert [r.user_agent for r in a.user_agents().collect()] == ["/a/", "/b/"]
    assert wire.one(a.user_agent_totals()).named == 2
    assert a.connection_durations().count() == 1
    assert a.peer_raster(3, 10, 10).count() == 6 and a.peer_marks(3, 10).count() == 1
    assert a.peer_activity(10, 5).count() > 0 and a.raster_marks(10).count() == 2
    assert [(r.peer_id, r.addr) for r in a.relay().collect()] == [(3, "10.0.0.3:8333"), (4, "10.0.0.4:8333")]
    assert wire.one(a.relay_totals()).duplicate_bytes == 400
    assert a.relay_distributions().count() == 2
    report = {r.request: r for r in a.exchanges().collect()}
    assert report["ping"].answered == 1 and report["version"].replies_captured is False
    # The version is still inside its window, so nothing is unanswered yet.
    assert wire.one(a.unanswered_is_meaningful())[0] is True
    with pytest.raises(ValueError):
        a.networks()
    a.load_prefixes(spark.createDataFrame([("10.0.0.0/8", 7)], "prefix string, asn long"))
    assert [(r.asn, r.peers) for r in a.networks().collect()] == [(7, 2)]
    assert wire.one(a.networks_total()).peers_covered == 2
    assert a.network_peers(7).count() == 2
    text = json.loads(wire.one(a.event_json(7)).json)
    assert text["command"] == "ping" and text["nonce"] == "0700000000000000" and "txid" not in text


def test_classify_is_stable(spark):
    df = wire.archive(spark, [wire.message(1, 1, "ping", True)])
    assert wire.rows(classify(df), "kind", "event_group") == [("ping", "message")]
