"""Files in and out, and streams against their batch results."""

import gzip
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.sources import files
from quern.streaming import streams


def test_growing_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1"}\n{"id": "2"}\n{"id": "3"}')
    (tmp_path / "b.jsonl").write_text('{"id": "4"}\n{"id": "5')
    ids = lambda final: sorted(r["id"] for r in files.jsonl_complete(spark, str(tmp_path), "id string", final).collect())
    assert ids(False) == ["1", "2", "4"] and ids(True) == ["1", "2", "3", "4"]


def test_shards_round_trip(spark, tmp_path):
    df = spark.range(50).select(F.col("id").cast("string").alias("text"))
    files.write_shards(df.coalesce(1), str(tmp_path / "c"), "train", 20)
    parts = sorted((tmp_path / "c" / "split=train").glob("*.json.gz"))
    assert len(parts) == 3 and gzip.open(parts[0], "rt").readline().startswith('{"text"')
    assert files.read_shards(spark, str(tmp_path / "c"), "train", "text string").count() == 50


def test_release_is_immutable_and_checked(spark, tmp_path):
    path = str(tmp_path / "r")
    manifest = [tuple(r) for r in files.release(spark.range(10), path).collect()]
    expected = spark.createDataFrame(manifest, "file string, bytes long, sha256 string")
    assert files.verify_release(spark, path, expected).count() == 0
    with pytest.raises(Exception, match="(?i)exist"):
        files.release(spark.range(1), path)
    victim = next((tmp_path / "r").glob("part-*"))
    victim.write_bytes(victim.read_bytes() + b"x")
    (victim.parent / f".{victim.name}.crc").unlink()
    assert [r["state"] for r in files.verify_release(spark, path, expected).collect()] == ["changed"]


def test_partitioned_export(spark, tmp_path):
    df = spark.createDataFrame([(1, datetime(2025, 1, 2), None), (2, datetime(2025, 2, 2), "law")], "i int, ts timestamp_ntz, d string")
    files.export_partitioned(df, str(tmp_path / "p"), "ts", F.col("d"))
    assert (tmp_path / "p/year=2025/month=1/domain=general").is_dir() and (tmp_path / "p/year=2025/month=2/domain=law").is_dir()


def test_sql_guard(spark):
    rows, more = files.sql_readonly(spark, "select * from range(5);", 3)
    assert rows.count() == 3 and more
    for bad in ("delete from x", "select 1; select 2", "", "insert into t values (1)"):
        with pytest.raises(ValueError):
            files.sql_readonly(spark, bad)


def test_log_numbers_go_on(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1)], "s string, i int")
    head = spark.createDataFrame([("s", 7)], "s string, head long")
    assert sorted(tuple(r) for r in files.numbered(df, "s", [F.col("i")], head).collect()) == [("s", 1, 8), ("s", 2, 9), ("t", 1, 1)]


@pytest.fixture
def events(spark, tmp_path):
    t = datetime(2025, 1, 1)
    rows = [(i, t + timedelta(minutes=7 * i), "u" + str(i % 2), "open" if i % 4 < 2 else "close") for i in range(40)] + [(3, t + timedelta(minutes=21), "u1", "close"), (99, t + timedelta(days=2), "u9", "open")]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, u string, kind string")
    df.coalesce(1).write.parquet(str(tmp_path / "e"))
    return streams.tail(spark, str(tmp_path / "e"), df.schema, "ts")


def test_windows_and_duplicates(spark, events):
    counts = streams.drain(streams.tumbling(events, "ts", [], "1 hour"))
    assert counts.agg(F.sum("n")).head()[0] == 41  # the last window is still open
    assert streams.drain(streams.once(events, "id", "ts")).count() == 41
    assert streams.drain(streams.sessions(events, "ts", "u", "30 minutes")).count() == 2
    assert streams.drain(streams.running(events, ["u"], n=F.count("*")), "complete").count() == 3


def test_spans(spark, events):
    got = streams.drain(streams.spans(events, "u", "ts", "kind", "open", "close"))
    assert got.where("state = 'closed' and ended >= started").count() == got.where("state = 'closed'").count() > 10


def test_states_go_on_after_a_restart(spark, tmp_path):
    t = datetime(2025, 1, 1)
    table = {("new", "deploy"): "shadow", ("shadow", "good"): "canary", ("canary", "good"): "live", ("*", "bad"): "rolled_back"}
    schema = "id int, ts timestamp_ntz, k string, e string"

    def write(name, rows):
        spark.createDataFrame([(i, t + timedelta(minutes=m), k, e) for i, (m, k, e) in enumerate(rows)], schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))

    def run():
        stream = streams.tail(spark, str(tmp_path / "in" / "*"), schema, "ts")
        moves = streams.transitions(stream, "k", "ts", "e", table, "new", order="id")
        return sorted((r["key"], r["before"], r["after"]) for r in streams.follow(moves, str(tmp_path / "out"), str(tmp_path / "check")).collect())

    write("a", [(0, "x", "deploy"), (1, "x", "good"), (2, "y", "deploy"), (2, "z", "good"), (3, "y", "noise")])
    first = run()
    assert first == [("x", "new", "shadow"), ("x", "shadow", "canary"), ("y", "new", "shadow")]
    assert run() == first  # nothing new, nothing twice
    write("b", [(5, "x", "good"), (6, "y", "bad"), (7, "z", "deploy")])
    assert run() == sorted([*first, ("x", "canary", "live"), ("y", "shadow", "rolled_back"), ("z", "new", "shadow")])
