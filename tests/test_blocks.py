"""Blocks on small inputs, with the values of the fixtures."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace import metrics, model
from millrace.config import CheckpointSettings, ScopedConfig
from millrace.functions import jsonx
from millrace.operators import enrich, flow, integrity, observe, parse, stateful
from millrace.pipeline import Pipeline
from millrace.plans import jobs
from millrace.sinks import sinks
from millrace.sources import cdc, streams

T0 = datetime(2024, 1, 1)


def env(spark, rows):
    """Rows (ms, key, operation, payload[, source])."""
    out = []
    for i, (ms, key, op, payload, *rest) in enumerate(rows):
        out.append((op, rest[0] if rest else "s", payload, T0 + timedelta(milliseconds=ms), i, None, f"t{i}", key, {}))
    return spark.createDataFrame(out, model.ENVELOPE)


def values(df, col="payload_json"):
    return [r[col] for r in df.orderBy("event_seq").collect()]


def test_dedup(spark):
    df = env(spark, [(i, v, "x", v) for i, v in enumerate("abacba")])
    assert values(integrity.Deduplicator(F.col("primary_key")).apply(df).main) == ["a", "b", "c"]
    df = env(spark, [(i, v[0], "x", v) for i, v in enumerate(["a1", "b1", "a2", "c1"])])
    assert values(integrity.Deduplicator(F.col("primary_key")).apply(df).main) == ["a1", "b1", "c1"]


def test_dedup_ttl_is_anchored_at_the_pass(spark):
    h = 3_600_000
    df = env(spark, [(0, "a", "x", "0"), (20 * h, "a", "x", "20"), (30 * h, "a", "x", "30"), (54 * h, "a", "x", "54"), (1, None, "x", "n"), (2, None, "x", "m")])
    assert values(integrity.Deduplicator(F.col("primary_key"), 24 * h).apply(df.repartition(3)).main) == ["0", "30", "54", "n"]


def test_change_suppressor(spark):
    p = lambda n, d: f'{{"name":"{n}","updatedAt":"{d}"}}'
    df = env(spark, [(0, "1", "u", p("Alice", 1)), (1, "2", "u", p("Bob", 1)), (2, "1", "u", p("Alice", 1)), (3, "2", "u", p("Bobby", 1)), (4, "1", "u", '{"updatedAt":"1", "name":"Alice"}')])
    assert len(values(integrity.ChangeSuppressor(F.col("primary_key")).apply(df).main)) == 3
    df = env(spark, [(0, "1", "u", p("Alice", 1)), (1, "1", "u", p("Alice", 2)), (2, "1", "u", None), (3, "1", "u", None)])
    assert len(values(integrity.ChangeSuppressor(F.col("primary_key"), excluded=("updatedAt",)).apply(df).main)) == 2


def test_schema(spark):
    v1 = integrity.SchemaVersion({"_id": "NUMBER", "name": "STRING"})
    v2 = integrity.SchemaVersion({"_id": "NUMBER", "name": "STRING", "email": "STRING"}, ("age",))
    df = env(spark, [(0, "k", "x", '{"_id":1,"name":"Alice"}'), (1, "k", "x", '{"_id":2}'), (2, "k", "x", None), (3, "k", "x", '{"_id":3,"name":"B","email":"e"}'), (4, "k", "x", '{"_id":null,"name":"B"}')])
    r = integrity.SchemaEnforcer((v1, v2)).apply(df)
    assert [r["event_seq"] for r in r.main.orderBy("event_seq").collect()] == [0, 3]
    messages = {d["error_message"] for d in r.dlq.collect()}
    assert "[v2] payload is null; [v1] payload is null" in messages
    assert "[v2] missing required field: _id, missing required field: email; [v1] missing required field: _id" in messages
    strict = integrity.SchemaEnforcer((integrity.SchemaVersion({"_id": "NUMBER"}, strict=True),)).apply(env(spark, [(0, "k", "x", '{"_id":1,"extra":"v"}')]))
    assert strict.dlq.first()["error_message"] == "[v1] unknown field: extra"
    with pytest.raises(ValueError):
        integrity.SchemaEnforcer(())


def test_constraints(spark):
    c = integrity.ConstraintEnforcer((integrity.NotNullRule("name"), integrity.RangeRule("age", 0, 200)))
    df = env(spark, [(0, "k", "x", '{"name":"Alice","age":30}'), (1, "k", "x", '{"age":25}'), (2, "k", "x", '{"name":"C","age":-5}'), (3, "k", "x", '{"name":"D","age":"twenty"}'), (4, "k", "x", '{"name":"E","age":null}'), (5, "k", "x", '{"name":"F"}')])
    r = c.apply(df)
    assert [x["event_seq"] for x in r.main.orderBy("event_seq").collect()] == [0, 5]
    assert {x["error_message"] for x in r.dlq.collect()} == {"name must not be null", "age must be between 0 and 200", "age is not a number"}
    f = integrity.ConstraintEnforcer((integrity.FormatRule.email("e"), integrity.FormatRule.date("d")))
    df = env(spark, [(0, "k", "x", '{"e":"a@b.com","d":"2026-02-14"}'), (1, "k", "x", '{"e":"not-email"}'), (2, "k", "x", '{"d":"14/02/2026"}'), (3, "k", "x", "{}"), (4, "k", "x", '{"e":null}'), (5, "k", "x", '{"d":"2026-02-14\\n"}')])
    assert [x["event_seq"] for x in f.apply(df).main.orderBy("event_seq").collect()] == [0, 3, 4]


def test_dynamic_joiner(spark):
    left = env(spark, [(0, "k", "x", "login"), (1, "k", "x", "click"), (2, None, "x", "none"), (3, "q", "x", "alone")])
    right = env(spark, [(0, "k", "x", "Alice"), (5, "k", "x", "Bob"), (6, None, "x", "none"), (7, "z", "x", "other"), (600_001, "k", "x", "late")])
    pairs = lambda how: sorted(((r["payload_json"], r["r_payload_json"]) for r in enrich.DynamicJoiner("primary_key", "primary_key", how)(left, right).collect()), key=str)
    inner = [("click", "Alice"), ("click", "Bob"), ("login", "Alice"), ("login", "Bob")]
    assert pairs("INNER") == inner
    assert pairs("LEFT") == sorted([*inner, ("alone", None)], key=str)
    assert pairs("RIGHT") == sorted([*inner, (None, "other"), (None, "late")], key=str)
    assert pairs("FULL_OUTER") == sorted([*inner, ("alone", None), (None, "other"), (None, "late")], key=str)
    for bad in ({"left_key": ""}, {"how": "CROSS"}, {"ttl_ms": 0}):
        with pytest.raises(ValueError):
            enrich.DynamicJoiner(**{"left_key": "a", "right_key": "b", **bad})


def test_static_and_as_of_join(spark):
    main = env(spark, [(10, "user1", "x", "login"), (11, "other", "x", "m"), (12, None, "x", "n"), (1, "user1", "x", "early")])
    ref = env(spark, [(5, "user1", "x", "Alice"), (20, "user1", "x", "Alicia"), (6, None, "x", "z")])
    got = {r["payload_json"]: r["metadata"].get("ref") for r in enrich.static_join_as_metadata(main, ref, "ref").collect()}
    assert got == {"login": "Alicia", "m": None, "n": None, "early": "Alicia"}
    got = {r["payload_json"]: r["ref_payload_json"] for r in enrich.as_of_join(main, ref, "primary_key", "primary_key", "event_time", "event_time").collect()}
    assert got == {"login": "Alice", "m": None, "n": None, "early": None}


def test_splitter(spark):
    df = env(spark, [(0, "k", "x", "ABC"), (1, "k", "x", "B"), (2, "k", None, None)])
    s = flow.ParallelSplitter().route("A", F.length("payload_json") > 2).route("B", F.col("payload_json").startswith("A"))
    with pytest.raises(ValueError):
        s.side("A")
    r = s.apply(df)
    assert values(r.sides["A"]) == ["ABC"] and values(s.side("B")) == [] and values(r.main) == ["B", None]
    c = flow.ParallelSplitter(True).route("A", F.col("payload_json").contains("B")).apply(df)
    assert values(c.main) == ["ABC", "B", None] and values(c.sides["A"]) == ["ABC", "B"]
    for bad in (lambda: flow.ParallelSplitter().apply(df), lambda: flow.Route(" ", F.lit(True)), lambda: flow.Route("a", None), lambda: s.side("zz")):
        with pytest.raises(ValueError):
            bad()


def test_fan_in(spark):
    a, b = env(spark, [(0, "k", "x", "a")]), env(spark, [(500, "k", "x", "b")])
    f = flow.WatermarkAlignedFanIn("5 seconds", tag=flow.tag_metadata()).source("orders", a)
    with pytest.raises(ValueError):
        f.merge()
    with pytest.raises(ValueError):
        f.source("orders", b)
    assert {r["metadata"]["ingestSource"] for r in f.source("payments", b).merge().collect()} == {"orders", "payments"}
    with pytest.raises(ValueError):
        flow.WatermarkAlignedFanIn().source("a", a).source("b", b).merge()


def test_observation(spark):
    df = env(spark, [(0, "k", "x", "a"), (10_001, "k", "x", "b"), (20_001, "k", "x", "c")])
    a = observe.FlowDisruptionDetector("primary_key", 10_000).alerts(df).collect()
    assert [(r["disrupted_at"], r["recovered_at"]) for r in a] == [(T0 + timedelta(seconds=10), T0 + timedelta(milliseconds=10_001))]
    open_end = observe.FlowDisruptionDetector("primary_key", 10_000, until=F.lit(T0 + timedelta(minutes=1))).alerts(df)
    assert open_end.count() == 2
    now = F.lit(T0 + timedelta(milliseconds=6000))
    lat = env(spark, [(0, "k", "x", ""), (1000, "k", "x", ""), (2000, "k", "x", "")])
    r = observe.LatencyDetector(5000, now=now).apply(lat.withColumn("event_time", F.when(F.col("event_seq") < 3, F.col("event_time"))))
    assert r.main.count() == 3
    assert r.observations["latency.latency"].get[metrics.key("latency", "alert")] == 1
    o = observe.OnlineObserver((observe.QualityCheck.is_null("payload_json"),)).apply(df)
    o.main.collect()
    assert o.observations["observer.observer"].get == {"observer.total_events": 3, "null_payload_json": 0}
    m = observe.MetadataDecorator("test-stage").apply(df.withColumn("metadata", F.create_map(F.lit("existing"), F.lit("value")))).main.first()["metadata"]
    assert m["existing"] == "value" and set(m) == {"existing", "stage.test-stage.taskName", "stage.test-stage.subtaskIndex", "stage.test-stage.processedAt"}
    assert len(metrics.catalogue()) == 41
    with pytest.raises(ValueError):
        metrics.key("filter", "nothing")


def test_materializer(spark):
    kinds = lambda m, df: [(r["change_type"], r["before"] and r["before"]["payload_json"], r["after"] and r["after"]["payload_json"]) for r in m.apply(df).main.orderBy("timestamp").collect()]
    df = env(spark, [(0, "k", "x", "v1"), (1, "k", "x", "v2")])
    assert kinds(stateful.Materializer(), df) == [("INSERT", None, "v1"), ("UPDATE", "v1", "v2")]
    merge = lambda a, b: F.struct(*[(F.concat(a[c], F.lit("+"), b[c]) if c == "payload_json" else b[c]).alias(c) for c in model.FIELDS])
    gone = F.col("operation") == "DEL"
    seq = env(spark, [(0, "k", "x", "a1"), (1, "k", "x", "a2"), (2, "k", "DEL", "d"), (3, "k", "x", "a3"), (50_000, "k", "x", "a4"), (50_001, "k", "x", "a5"), (50_002, "k", "DEL", "d"), (50_003, "k", "DEL", "d")])
    want = [("INSERT", None, "a1"), ("UPDATE", "a1", "a1+a2"), ("DELETE", "a1+a2", None), ("INSERT", None, "a3"), ("INSERT", None, "a4"), ("UPDATE", "a4", "a4+a5"), ("DELETE", "a4+a5", None), ("DELETE", None, None)]
    assert kinds(stateful.Materializer(delete=gone, merge=merge, ttl_ms=10_000), seq) == want
    assert [k[0] for k in kinds(stateful.Materializer(delete=gone, ttl_ms=10_000), seq)] == [w[0] for w in want]
    assert stateful.current_state(seq, delete=gone).count() == 0


def test_sessions(spark):
    s = lambda ms, gap: [(r["session_start"], r["session_end"], r["event_count"], r["duration_ms"]) for r in stateful.SessionAnalyzer(gap_ms=gap, result=stateful.actions_result()).apply(env(spark, [(m, "k", "v", "p") for m in ms])).main.orderBy("session_start").collect()]
    assert [x[2] for x in s([1000, 2000, 10000, 11000], 5000)] == [2, 2]
    assert s([1000, 3000, 5000], 10000) == [(T0 + timedelta(seconds=1), T0 + timedelta(seconds=15), 3, 14000)]
    assert [x[2] for x in s([3000, 1000, 2000], 5000)] == [3]
    with pytest.raises(ValueError):
        stateful.SessionAnalyzer(gap_ms=0)
    e = env(spark, [(1000, "u", "VIEW", "p"), (2000, "u", "ADD_CART", "p"), (3500, "u", "CHECKOUT", "p")])
    r = jobs.user_sessions(e, 5000).main.first()
    assert r["payload_json"] == '{"_id":"u","actions":"VIEW,ADD_CART,CHECKOUT","count":3}' or sorted(__import__("json").loads(r["payload_json"]).items()) == [("_id", "u"), ("actions", "VIEW,ADD_CART,CHECKOUT"), ("count", 3)]
    assert r["metadata"]["duration"] == "PT7.5S" and r["metadata"]["eventCount"] == "3" and r["primary_key"] == "_id"


def test_parsers(spark):
    df = spark.createDataFrame([('{"operation":"insert","source":"orders","payloadJson":"{\\"id\\":123}","metadata":{"a":"b"},"other":1}',), ("{invalid-json}",), ("text",), (None,), (' {"operation":{"x":1}} ',)], "value string")
    r = parse.EnvelopeParser().apply(df)
    row = r.main.first()
    assert r.main.count() == 1 and (row["operation"], row["payload_json"], row["metadata"]) == ("insert", '{"id":123}', {})
    assert row["event_time"] is not None
    assert r.dlq.count() == 2
    assert parse.EnvelopeParser(keep_metadata=True).apply(df).main.first()["metadata"] == {"a": "b"}
    docs = [("insert", None, "users", None, '{"_id":1,"name":"Alice"}', None, (1700000000, 5)), ("update", None, "users", '{"_id":5}', None, '{"updatedFields":{"age":30}}', None), ("delete", None, None, '{"_id":7}', None, None, None), (None, None, "users", None, "{}", None, None), ("odd", None, "users", None, '{"_id":2}', None, None)]
    c = parse.CdcParser().apply(spark.createDataFrame(docs, model.CDC_DOC))
    got = {r["primary_key"]: r for r in c.main.collect()}
    assert {k: r["operation"] for k, r in got.items()} == {"1": "insert", "5": "update", "7": "delete", "2": "unknown"}
    assert got["1"]["event_seq"] == 5 and got["7"]["source"] == "unknown"
    assert jsonx is not None and __import__("json").loads(got["5"]["payload_json"]) == {"age": 30, "_id": 5}
    assert c.dlq.first()["error_type"] == "PARSING_ERROR"


def test_envelope_needs_operation_and_source(spark):
    one = spark.range(1)
    assert one.select(*model.envelope(F.lit("a"), F.lit("b"))).first()["operation"] == "a"
    with pytest.raises(Exception, match="source must not be null"):
        one.select(*model.envelope(F.lit("a"), F.lit(None))).collect()


def test_jobs(spark):
    e = env(spark, [(0, "o1", "c", "{}", "orders"), (1, "o1", "p", "PAID", "payments"), (2, "o2", "c", "{}", "orders"), (3, "o1", "p", "PENDING", "payments"), (4, "x", "i", "{}", "inventory")])
    r = jobs.order_payments(e.where("source='orders'"), e.where("source='payments'")).main.collect()
    assert sorted((x["primary_key"], x["metadata"].get("paymentPayload") or "") for x in r) == [("o1", "PAID"), ("o1", "PENDING"), ("o2", "")]
    routed = jobs.event_router(e)
    assert routed.main.count() == 1 and routed.sides["orders"].count() == 2
    u = env(spark, [(0, "u", "CREATE", '{"a":1}'), (1, "u", "UPDATE", '{"a":2}'), (2, "u", "delete", "{}"), (3, "u", "CREATE", '{"a":3}')])
    assert [x["operation"] for x in jobs.user_state(u).main.orderBy("event_time").collect()] == ["CHANGELOG_INSERT", "CHANGELOG_UPDATE", "CHANGELOG_DELETE", "CHANGELOG_INSERT"]
    c = spark.createDataFrame([("insert", None, "u", None, '{"_id":1}', None, (1, 1)), ("other", None, "u", None, '{"_id":2}', None, (1, 2)), ("update", None, "u", '{"_id":3}', None, '{"updatedFields":{"a":1}}', (1, 3)), ("insert", None, "u", None, '{"b":1}', None, (1, 4))], model.CDC_DOC)
    m = jobs.cdc_to_broker(c)
    assert {x["primary_key"] for x in m.main.collect()} == {"1", "3"}
    assert [x["error_type"] for x in m.dlq.collect()] == ["SCHEMA_VIOLATION"]
    assert sorted(jobs.REGISTRY) == ["EventRouter", "KafkaToMongo", "MergedIngest", "MongoToKafka", "OrderPaymentJoin", "UserSessionAnalysis", "UserStateMaterialize"]


def test_sinks(spark, tmp_path):
    e = env(spark, [(0, "user-123", "delete", "{}"), (1, None, "x", "{}")])
    rec = sinks.BrokerSink("t", compacted=True).records(e).collect()
    assert bytes(rec[0]["key"]) == b"user-123" and rec[0]["value"] is None and rec[1]["key"] is None and rec[1]["value"] is not None
    assert sinks.BrokerSink("t").records(e).first()["value"] is not None
    ops = env(spark, [(0, "1", "insert", '{"_id":1,"n":"A"}'), (1, "3", "insert", '{"_id":3,"n":"Charlie"}'), (2, "3", "update", '{"_id":3,"n":"Charlotte"}'), (3, "1", "DELETE", '{"_id":1}'), (4, None, "insert", '{"n":1}'), (5, "9", "insert", "bad")])
    sink = sinks.UpsertSink()
    w = sink.parquet_writer(f"{tmp_path}/c")
    w(ops.where("event_seq < 2"), 0)
    w(ops.where("event_seq >= 2"), 1)
    w(ops.where("event_seq >= 2"), 1)
    assert sinks.latest_version(spark, f"{tmp_path}/c") == 1
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/c/v=1").collect()] == [("3", '{"_id":3,"n":"Charlotte"}')]
    assert [r["error_type"] for r in sink.split(ops).dlq.collect()] == ["SINK_ERROR"]
    sinks.DlqSink(f"{tmp_path}/dlq").write(sink.split(ops).dlq)
    assert spark.read.text(f"{tmp_path}/dlq").count() == 1
    s = env(spark, [(0, "k", "a", "1"), (1, "k", "b", "2")]).withColumn("trace_id", F.when(F.col("event_seq") == 0, " ").otherwise("t"))
    assert [r["id"] for r in sinks.SearchSink().documents(s).collect()] == ["t"] and sinks.SearchSink().skipped(s) == 1


def test_pipeline_and_config(spark, tmp_path, monkeypatch):
    e = env(spark, [(0, "k", "a", '{"_id":1}'), (1, "k", "b", "{}")])
    p = Pipeline.source(e).apply(integrity.SchemaEnforcer((integrity.SchemaVersion({"_id": "ANY"}),))).process(lambda d: d.withColumn("trace_id", F.lit("z")))
    assert p.to(lambda d: d.count()) == 1 and p.dlq.count() == 1
    (tmp_path / "c.json").write_text('{"common":{"A":"1","B":"c"},"job":{"B":"j","C":" "}}')
    (tmp_path / ".env").write_text("# x\nD='dot'\n")
    c = ScopedConfig.load("job", str(tmp_path / "c.json"), str(tmp_path / ".env"), O="over")
    assert (c.require("A"), c.require("B"), c.get("C", "d"), c.require("D"), c.require("O"), c.get_global("B")) == ("1", "j", "d", "dot", "over", "c")
    monkeypatch.setenv("B", "env")
    assert c.require("B") == "env" and not c.exists("C")
    with pytest.raises(ValueError):
        c.require("C")
    assert (CheckpointSettings().pause_seconds, CheckpointSettings().timeout_seconds) == (30, 120)
    with pytest.raises(streams.MissingConnector):
        streams.collection(spark, ScopedConfig(overrides={"MONGO_URI": "u", "MONGO_DB": "d", "MONGO_COLLECTION": "c"}))


def test_splits_are_a_partition(spark):
    df = spark.range(100)
    got = cdc.hash_splits(df, "id", 4)
    assert sorted(r["id"] for r in got.collect()) == list(range(100)) and got.select("_split").distinct().count() == 4
    assert cdc.hash_splits(df, "id", 1).count() == 100


def test_counters(spark):
    df = env(spark, [(0, "k", "a", '{"_id":1}', "orders"), (1, "k", "b", "{}", "payments"), (2, "k", None, "{}", "x")])
    f = parse.FilterInterceptor(F.col("operation") == "a", counted=True).apply(df)
    assert f.main.count() == 1
    assert f.observations["filter"].get == {"filter.pass_count": 1, "filter.drop_count": 2}
    for copy in (False, True):
        s = flow.ParallelSplitter(copy, counted=True).route("o", F.col("source") == "orders").apply(df)
        s.main.collect()
        assert s.observations["splitter"].get == {"splitter.route.o_count": 1, "splitter.unmatched_count": 2}
    e = integrity.SchemaEnforcer((integrity.SchemaVersion({"_id": "ANY"}),), counted=True).apply(df)
    e.main.collect()
    assert e.observations["schema.SchemaEnforcer"].get == {"schema.pass_count": 1, "schema.violation_count": 2}


def test_launcher(spark, tmp_path, capsys):
    from millrace.__main__ import main

    assert main([]) == 1 and main(["Nothing", "a", "b"]) == 1
    assert "UserSessionAnalysis" in capsys.readouterr().err
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"operation":"VIEW","source":"s","primaryKey":"u","eventTime":"2024-01-01T00:00:00Z"}\n{bad}\n')
    assert main(["UserSessionAnalysis", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert spark.read.json(f"{tmp_path}/out/main").first()["operation"] == "SESSION_CLOSED"
    assert spark.read.text(f"{tmp_path}/out/dlq").count() == 1


def test_integrity_with_odd_rows_and_names(spark):
    t = datetime(2024, 1, 1)
    rows = [(None, None, 0, "x", 1), (None, None, 1, "x", 2), ("", t, 2, "x", 3), ("", t, 3, "y", 4), ("k", t, 4, "x", 5)]
    schema = "key string, event_time timestamp, event_seq long, payload_json string, _k long"
    for extra in ("_key", "_h", "_t", "_n"):
        df = spark.createDataFrame(rows, schema).withColumn(extra, F.lit("mine"))
        for block, n in ((integrity.Deduplicator(F.col("key")), 3), (integrity.Deduplicator(F.col("key"), 1000), 3), (integrity.ChangeSuppressor(F.col("key")), 4), (integrity.ChangeSuppressor(F.col("key"), ttl_ms=1000), 4)):
            got = block.apply(df).main
            assert got.columns == df.columns
            out = got.collect()
            assert len(out) == n and {r[extra] for r in out} == {"mine"}


def test_parser_binds_each_text_once(spark):
    from millrace.operators.parse import EnvelopeParser

    df = spark.createDataFrame([('{"operation":"a","payloadJson":{"x":1}}',), ('{"operation":1,"eventTime":"2024-01-01T00:00:00.123456Z"}',), ('{"eventTime":"nope"}',), ('{"source":[]}',), (" {} ",), ("{",), ("x",), (None,)], "value string")
    got = EnvelopeParser().apply(df)
    plan = got.main._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 1
    assert sorted((r["operation"] or "") for r in got.main.collect()) == ["", "1"]
    assert got.dlq.count() == 3


def test_silence_over_many_hours(spark):
    """Gaps within and between the hours in which a key's rows are sorted, against a direct walk."""
    import random

    rnd = random.Random(9)
    times = {k: sorted(rnd.randrange(30 * 3_600_000) for _ in range(n)) for k, n in (("hot", 400), ("cold", 5), ("one", 1))}
    df = env(spark, [(t, k, "x", "p") for k, ts in times.items() for t in ts] + [(0, None, "x", "p")])
    df = df.unionByName(df.where("primary_key = 'one'").withColumn("event_time", F.lit(None).cast("timestamp")))
    for timeout in (60_000, 900_000, 7_200_000):
        got = sorted((r["key"], r["disrupted_at"], r["recovered_at"]) for r in observe.FlowDisruptionDetector("primary_key", timeout).alerts(df).collect())
        at = lambda ms: T0 + timedelta(milliseconds=ms)
        assert got == sorted((k, at(a + timeout), at(b)) for k, ts in times.items() for a, b in zip(ts, ts[1:], strict=False) if b - a > timeout)


def test_as_of_rows_without_a_key(spark):
    main = env(spark, [(10, None, "m", "a"), (20, "k", "m", "b"), (5, "", "m", "c")])
    ref = env(spark, [(0, "k", "r", "R"), (0, None, "r", "N")])
    got = {r["payload_json"]: r["ref_payload_json"] for r in enrich.as_of_join(main, ref, "primary_key", "primary_key", "event_time", "event_time").collect()}
    assert got == {"a": None, "b": "R", "c": None}


def test_counters_of_blocks(spark):
    texts = spark.createDataFrame([('{"operation":"a"}',), ('{"source":[]}',), ("x",)], "value string")
    p = parse.EnvelopeParser(counted=True).apply(texts)
    assert p.main.count() == 1
    assert p.observations["parser"].get == {"parser.success_count": 1, "parser.error_count": 1}
    df = env(spark, [(0, "k", "x", "{}"), (1, "k", "x", "{}"), (2, "k", "DEL", "{}"), (3, None, None, None, None)])
    m = stateful.Materializer(delete=F.col("operation") == "DEL", counted=True).apply(df)
    m.main.collect()
    assert m.observations["materializer"].get == {"materializer.insert_count": 1, "materializer.update_count": 1, "materializer.delete_count": 1}
    s = stateful.SessionAnalyzer(counted=True).apply(df)
    s.main.collect()
    assert s.observations["session"].get == {"session.closed_count": 1}
    r = parse.Processor(strict=True, counted=True).apply(df)
    assert r.main.count() == 3
    assert r.observations["processor"].get == {"processor.success_count": 3, "processor.error_count": 1}
    d = observe.MetadataDecorator("s", counted=True).apply(df)
    d.main.collect()
    assert d.observations["decorator"].get == {"decorator.event_count": 4}
    late = observe.LatencyDetector(0, now=F.lit(T0 + timedelta(milliseconds=7))).apply(df)
    late.main.collect()
    assert late.observations["latency.latency"].get["latency.max_ms"] == 7
