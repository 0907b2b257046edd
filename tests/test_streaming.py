"""Streaming twins give what the bounded blocks give; sentinels far ahead close open sessions."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace import model
from millrace.operators import enrich, integrity, parse, stateful
from millrace.sources import cdc
from millrace.streaming import processors

T0 = datetime(2024, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def stream(spark, tmp_path, rows, name="in"):
    """A file stream of envelopes (ms, key, operation, payload), all in one file."""
    out = [(op, "s", p, T0 + timedelta(milliseconds=ms), i, None, f"t{i}", k, {}) for i, (ms, k, op, p) in enumerate(rows)]
    path = f"{tmp_path}/{name}"
    spark.createDataFrame(out, model.ENVELOPE).coalesce(1).write.parquet(path)
    return spark.readStream.schema(model.ENVELOPE).parquet(path)


def drain(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return df.sparkSession.table(name).collect()


def run_state(df, tmp_path, name):
    """A processing-time query has no end; it is stopped after its first rows are committed."""
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp-{name}").start()
    try:
        for _ in range(240):
            assert q.exception() is None
            if any(p.numInputRows for p in q.recentProgress):
                break
            time.sleep(0.5)
        return df.sparkSession.table(name).collect()
    finally:
        q.stop()


def test_sessions(rocks, tmp_path):
    rows = [(1000, "u", "a", "p"), (2000, "u", "b", "p"), (20_000, "u", "c", "p"), (10**9, "zz", "end", "p")]
    s = stateful.SessionAnalyzer(gap_ms=5000, result=stateful.actions_result()).apply(stream(rocks, tmp_path, rows)).main
    got = sorted((r["key"], json.loads(r["result"])["actions"]) for r in drain(s, tmp_path, "sessions"))
    assert got == [("u", "a,b"), ("u", "c")]


def test_left_join(rocks, tmp_path):
    left = stream(rocks, tmp_path, [(0, "k", "l", "L"), (1, "q", "l", "alone"), (10**9, "zz", "l", "end")], "l").withWatermark("event_time", "1 second")
    right = stream(rocks, tmp_path, [(5, "k", "r", "R1"), (6, "k", "r", "R2"), (10**9, "zy", "r", "end")], "r").withWatermark("event_time", "1 second")
    j = enrich.DynamicJoiner("primary_key", "primary_key", "LEFT", 10_000)(left, right)
    got = {(r["payload_json"], r["r_payload_json"]) for r in drain(j.select("payload_json", "r_payload_json"), tmp_path, "joined") if r["payload_json"] != "end"}
    assert {("L", "R1"), ("L", "R2")} <= got <= {("L", "R1"), ("L", "R2"), ("alone", None)}


def test_dedup_suppress_materialize(rocks, tmp_path):
    rows = [(0, "a", "x", "1"), (1, "b", "x", "1"), (2, "a", "x", "1"), (3, "a", "x", "2"), (4, "b", "DEL", "2")]
    df = stream(rocks, tmp_path, rows)
    d = run_state(integrity.Deduplicator(F.col("primary_key"), 600_000).apply(df).main, tmp_path, "dedup")
    assert sorted(r["primary_key"] for r in d) == ["a", "b"] and all(r["event_time"] is not None for r in d)
    s = run_state(integrity.ChangeSuppressor(F.col("primary_key"), ttl_ms=600_000).apply(df).main, tmp_path, "suppressed")
    assert len(s) == 4
    c = run_state(stateful.Materializer(delete=F.col("operation") == "DEL", ttl_ms=600_000).apply(df).main, tmp_path, "changes")
    assert sorted(r["change_type"] for r in c) == ["DELETE", "INSERT", "INSERT", "UPDATE", "UPDATE"]
    assert processors.dedup_within_watermark(df, ["primary_key"], "event_time", "1 hour").isStreaming


def test_change_log_source(rocks, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    docs = [{"op": "insert", "collection": "users", "documentKey": {"_id": i}, "fullDocument": {"_id": i, "n": "x"}, "clusterTime": {"sec": 1700000000, "inc": i}} for i in range(20)]
    (log / "0.json").write_text("\n".join(map(json.dumps, docs)))
    parsed = parse.CdcParser().apply(cdc.multi_reader(rocks, str(log), 4)).main
    assert sorted(int(r["primary_key"]) for r in drain(parsed, tmp_path, "cdc")) == list(range(20))
    rest = drain(cdc.change_stream(rocks, str(log), start="15"), tmp_path, "resumed")
    assert len(rest) == 5
    with pytest.raises(cdc.LostPosition):
        cdc.ChangeLogReader({"path": str(log), "startToken": "99"}).initialOffset()
    assert cdc.ChangeLogReader({"path": str(log), "startToken": "99", "onLostPosition": "latest"}).initialOffset() == {"token": 20}


def test_state_keeps_microseconds_and_tells_keys_apart(rocks, tmp_path):
    at = T0 + timedelta(microseconds=123456)
    rows = [(op, "s", "p", at, i, None, "t", k, {}) for i, (k, op) in enumerate([(None, "a"), ("", "a"), (None, "b"), ("-", "a"), ("=", "a")])]
    path = f"{tmp_path}/micro"
    rocks.createDataFrame(rows, model.ENVELOPE).coalesce(1).write.parquet(path)
    df = rocks.readStream.schema(model.ENVELOPE).parquet(path)
    got = run_state(integrity.Deduplicator(F.col("primary_key"), 600_000).apply(df).main, tmp_path, "micro")
    assert sorted((str(r["primary_key"]), r["operation"]) for r in got) == [("", "a"), ("-", "a"), ("=", "a"), ("None", "a")]
    assert {r["event_time"] for r in got} == {at}
    batch = integrity.Deduplicator(F.col("primary_key"), 600_000).apply(rocks.read.schema(model.ENVELOPE).parquet(path)).main.collect()
    assert sorted((str(r["primary_key"]), r["operation"]) for r in batch) == sorted((str(r["primary_key"]), r["operation"]) for r in got)


def test_materializer_merges_like_the_bounded_form(rocks, tmp_path):
    rows = [(0, "a", "x", "1"), (1, "a", "x", "2"), (2, "a", "DEL", "3"), (3, "a", "x", "4"), (4, "b", "x", "5")]
    df = stream(rocks, tmp_path, rows)
    columns = lambda acc, new: new.withField("payload_json", F.concat(acc["payload_json"], new["payload_json"]))
    dicts = lambda acc, new: new | {"payload_json": acc["payload_json"] + new["payload_json"]}
    told = lambda got: sorted((r["change_type"], r["key"], r["before"] and r["before"]["payload_json"], r["after"] and r["after"]["payload_json"], r["timestamp"]) for r in got)
    m = stateful.Materializer(delete=F.col("operation") == "DEL", merge=columns, row_merge=dicts, ttl_ms=600_000)
    twin = told(run_state(m.apply(df).main, tmp_path, "merged"))
    assert ("UPDATE", "a", "1", "12") in [t[:4] for t in twin]
    assert twin == told(m.apply(rocks.read.schema(model.ENVELOPE).parquet(f"{tmp_path}/in")).main.collect())
    with pytest.raises(ValueError, match="row_merge"):
        stateful.Materializer(merge=columns).apply(df)


def lines(folder):
    return [json.loads(x) for p in sorted(folder.glob("**/part-*.txt")) for x in p.read_text().splitlines()]


def test_job_runs_and_resumes(rocks, tmp_path):
    """A running job: text files in, documents and dead letters out; a second run reads only what is new."""
    from millrace.plans import runner
    from millrace.sinks.sinks import latest_version

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    say = lambda i, x, op="insert": json.dumps({"operation": op, "source": "orders", "payloadJson": json.dumps({"_id": i, "x": x}), "primaryKey": str(i), "eventTime": f"2024-01-01T00:00:0{x}Z"})
    (src / "a.txt").write_text("\n".join([say(1, 1), say(2, 1), '{"source": []}', say(1, 2)]))
    runner.start(rocks, "KafkaToMongo", [str(src)], str(out), once=True).wait(120)
    (src / "b.txt").write_text("\n".join([say(2, 3, "DELETE"), say(3, 3), json.dumps({"operation": "insert", "payloadJson": "{}"})]))
    runner.start(rocks, "KafkaToMongo", [str(src)], str(out), once=True).wait(120)
    last = latest_version(rocks, f"{out}/main")
    got = {r["key"]: json.loads(r["document"])["x"] for r in rocks.read.parquet(f"{out}/main/v={last}").collect()}
    assert got == {"1": 2, "3": 3}
    assert sorted(x["error_type"] for x in lines(out / "dlq")) == ["CONSTRAINT_VIOLATION", "PARSING_ERROR"]


def test_routes_of_a_running_job(rocks, tmp_path):
    from millrace.plans import runner

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "a.txt").write_text("\n".join(json.dumps({"operation": "a", "source": s}) for s in ("orders", "payments", "orders", "other")))
    job = runner.start(rocks, "EventRouter", [str(src)], str(out), once=True)
    job.wait(120)
    assert {k: len(lines(out / k)) for k in ("main", "orders", "payments", "dlq")} == {"main": 1, "orders": 2, "payments": 1, "dlq": 0}


def test_failed_dead_letters_stop_nothing(rocks, tmp_path):
    from millrace.sinks.sinks import BrokerSink, DlqSink

    (tmp_path / "file").write_text("x")
    sink = DlqSink(f"{tmp_path}/file/below")
    assert sink.write(rocks.createDataFrame([], model.DLQ)) is False and sink.failed == 1
    with pytest.raises(ValueError, match="at-least-once"):
        BrokerSink("t", exactly_once=True).write(rocks.createDataFrame([], model.ENVELOPE), None)


def test_change_log_by_files_and_bad_lines(rocks, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    say = lambda i: json.dumps({"op": "insert", "collection": "c", "documentKey": {"_id": i}, "fullDocument": {"_id": i}})
    (log / "0.json").write_text("\n".join(map(say, range(5))) + "\n\n")
    (log / "1.json").write_text("\n".join([say(5), "not json", '["x"]', say(6)]))
    r = cdc.ChangeLogReader({"path": f"file://{log}", "splits": "2"})
    assert r.latestOffset() == {"token": 9}
    assert [p.pieces for p in r.partitions({"token": 3}, {"token": 6})] == [[(f"{log}/0.json", 3, 5), (f"{log}/1.json", 0, 1)]] * 2
    with (log / "1.json").open("a") as f:
        f.write("\n" + say(7) + "\n")
    assert r.latestOffset() == {"token": 10}
    parsed = parse.CdcParser().apply(cdc.multi_reader(rocks, str(log), 3))
    assert sorted(int(x["primary_key"]) for x in drain(parsed.main, tmp_path, "files")) == list(range(8))
    assert sorted(json.loads(x["raw_event"])["full_document"] for x in drain(parsed.dlq, tmp_path, "bad")) == ['["x"]', "not json"]
