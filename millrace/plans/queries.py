"""One registered query per block and job over the driver's tables, each with its SQL oracle.

Results hold scalars only; times are naive UTC.  Gaps and TTLs are hours, as users' events
lie hours apart.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model
from ..operators import enrich, flow, integrity, observe, parse, stateful
from ..sinks import sinks
from ..sources import cdc
from . import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
HOUR = 3_600_000

ENV = """env AS (SELECT event_type AS operation,
  CASE event_type WHEN 'purchase' THEN 'payments' WHEN 'signup' THEN 'orders' ELSE event_type END AS source,
  props AS payload_json, ts AS event_time, event_id AS event_seq, 'trace-' || event_id AS trace_id,
  CAST(user_id AS VARCHAR) AS primary_key FROM events)"""


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def env(spark: SparkSession, d: str) -> DataFrame:
    return model.envelope_from_events(load(spark, d, "events"))


def naive(c: str, name: str | None = None) -> Column:
    return F.col(c).cast("timestamp_ntz").alias(name or c.split(".")[-1])


def plain(df: DataFrame) -> DataFrame:
    """An envelope's scalar columns that are the same in each run."""
    return df.select("operation", "source", "payload_json", naive("event_time"), "event_seq", "trace_id", "primary_key")


PLAIN = "operation, source, payload_json, event_time, event_seq, trace_id, primary_key"


@query("scan_project", f"WITH {ENV} SELECT {PLAIN} FROM env")
def scan_project(spark, d):
    return plain(env(spark, d))


# --- parsing -------------------------------------------------------------------------

def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Envelopes as JSON text: each tenth is broken, each tenth is no object at all."""
    e = env(spark, d)
    iso = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    good = F.to_json(F.struct("operation", "source", F.col("payload_json").alias("payloadJson"), iso.alias("eventTime"), F.col("event_seq").alias("eventSeq"), F.col("trace_id").alias("traceId"), F.col("primary_key").alias("primaryKey"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata")))
    bad = F.concat(F.lit('{"operation": "x", "eventSeq": '), F.col("event_seq").cast("string"), F.lit(",}"))
    return e.select(F.when(F.col("event_seq") % 10 == 0, bad).when(F.col("event_seq") % 10 == 1, "no object").otherwise(good).alias("value"))


@query("parse_ok", f"WITH {ENV} SELECT {PLAIN}, CAST(0 AS BIGINT) AS n_metadata FROM env WHERE event_seq % 10 > 1")
def parse_ok(spark, d):
    r = parse.EnvelopeParser().apply(_texts(spark, d)).main
    return r.select("operation", "source", "payload_json", naive("event_time"), "event_seq", "trace_id", "primary_key", F.size("metadata").cast("long").alias("n_metadata"))


@query("parse_dlq", """SELECT 'PARSING_ERROR' AS error_type, '{"operation": "x", "eventSeq": ' || event_id || ',}' AS raw_event FROM events WHERE event_id % 10 = 0""")
def parse_dlq(spark, d):
    return parse.EnvelopeParser().apply(_texts(spark, d)).dlq.select("error_type", "raw_event")


@query("dlq_replay", """SELECT '{"operation": "x", "eventSeq": ' || event_id || ',}' AS value FROM events WHERE event_id % 10 = 0""")
def dlq_replay(spark, d):
    return sinks.replay(parse.EnvelopeParser().apply(_texts(spark, d)).dlq)


def _changes(spark: SparkSession, d: str) -> DataFrame:
    """Change documents of six kinds, by event id."""
    i = F.col("event_id")
    code = F.element_at(F.array(*map(F.lit, ("c", "u", "d", "insert", "replace", "other"))), (i % 6 + 1).cast("int"))
    key = F.concat(F.lit('{"_id":'), F.col("user_id").cast("string"), F.lit("}"))
    doc = F.concat(F.lit('{"_id":'), F.col("user_id").cast("string"), F.lit(',"v":'), i.cast("string"), F.lit("}"))
    upd = F.concat(F.lit('{"updatedFields":{"age":'), (i % 90).cast("string"), F.lit("}}"))
    return load(spark, d, "events").select(
        code.alias("op"), F.lit("db").alias("db"), F.col("event_type").alias("collection"), key.alias("document_key"),
        F.when(~(i % 6).isin(1, 2), doc).alias("full_document"), F.when(i % 6 == 1, upd).alias("update_description"),
        F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).alias("sec"), (i % 1000).cast("int").alias("inc")).alias("cluster_time"), i.alias("event_id"),
    )


@query(
    "cdc_parse",
    """SELECT CASE event_id % 6 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'insert' WHEN 4 THEN 'update' ELSE 'unknown' END AS operation,
    event_type AS source, CAST(user_id AS VARCHAR) AS primary_key, date_trunc('second', ts) AS event_time, CAST(event_id % 1000 AS BIGINT) AS event_seq,
    CASE WHEN event_id % 6 = 1 THEN CAST(event_id % 90 AS VARCHAR) END AS age, CASE WHEN event_id % 6 NOT IN (1, 2) THEN CAST(event_id AS VARCHAR) END AS v FROM events""",
)
def cdc_parse(spark, d):
    r = parse.CdcParser().apply(_changes(spark, d)).main
    return r.select("operation", "source", "primary_key", naive("event_time"), "event_seq", F.get_json_object("payload_json", "$.age").alias("age"), F.get_json_object("payload_json", "$.v").alias("v"))


@query("cdc_split", "SELECT event_id FROM events")
def cdc_split(spark, d):
    return cdc.hash_splits(load(spark, d, "events"), "user_id", 4).select("event_id")


@query("filter_unknown", f"WITH {ENV} SELECT {PLAIN} FROM env WHERE operation IS DISTINCT FROM 'error'")
def filter_unknown(spark, d):
    return plain(parse.FilterInterceptor(parse.differs("operation", "error")).apply(env(spark, d)).main)


@query("process_trace", "SELECT count(*) AS n, count(*) FILTER (event_id % 3 <> 0) AS kept, count(*) FILTER (event_id % 3 = 0) AS made FROM events")
def process_trace(spark, d):
    e = env(spark, d).withColumn("trace_id", F.when(F.col("event_seq") % 3 != 0, F.col("trace_id")))
    r = parse.Processor().apply(e).main
    kept = F.col("trace_id") == F.concat(F.lit("trace-"), F.col("event_seq").cast("string"))
    return r.agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"), F.count_if(~kept & F.col("trace_id").rlike("^trace-[0-9a-f-]{36}$")).alias("made"))


# --- integrity -----------------------------------------------------------------------

def _key(*cols: str) -> Column:
    return F.concat_ws("|", *cols)


@query("dedup_first", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first(spark, d):
    return integrity.Deduplicator(_key("primary_key", "operation", "payload_json")).apply(env(spark, d)).main.select(F.col("event_seq").alias("event_id"))


def _ttl_oracle(state: str = "0") -> str:
    return f"""WITH RECURSIVE o AS (SELECT user_id || '|' || event_type AS k, ts, event_id, {state} AS s,
      row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT k, event_id, n, ts AS anchor, s, true AS pass FROM o WHERE n = 1
      UNION ALL SELECT o.k, o.event_id, o.n, CASE WHEN o.ts >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s THEN o.ts ELSE r.anchor END,
        CASE WHEN o.ts >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s THEN o.s ELSE r.s END,
        o.ts >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)
    SELECT event_id FROM r WHERE pass"""


@query("dedup_ttl", _ttl_oracle())
def dedup_ttl(spark, d):
    return integrity.Deduplicator(_key("primary_key", "operation"), 24 * HOUR).apply(env(spark, d)).main.select(F.col("event_seq").alias("event_id"))


@query("merge_suppress", "SELECT event_id FROM (SELECT event_id, props, lag(props) OVER w AS p, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n = 1 OR p IS DISTINCT FROM props")
def merge_suppress(spark, d):
    return integrity.ChangeSuppressor(_key("primary_key", "operation")).apply(env(spark, d)).main.select(F.col("event_seq").alias("event_id"))


@query("merge_suppress_ttl", _ttl_oracle("props"))
def merge_suppress_ttl(spark, d):
    return integrity.ChangeSuppressor(_key("primary_key", "operation"), ttl_ms=24 * HOUR).apply(env(spark, d)).main.select(F.col("event_seq").alias("event_id"))


def _varied(spark: SparkSession, d: str) -> DataFrame:
    """Payloads of several shapes, by event id."""
    i = F.col("event_seq") % 7
    shape = F.when(i == 0, '{"k":"x"}').when(i == 1, '{"q":1}').when(i == 2, '{"k":5,"extra":2}').when(i == 3, '{"k":7,"z":"t"}').when(i == 4, "[1]").otherwise(F.col("payload_json"))
    return env(spark, d).withColumn("payload_json", shape)


V1, V2 = integrity.SchemaVersion({"k": "NUMBER"}), integrity.SchemaVersion({"k": "NUMBER", "z": "STRING"})


@query("schema_pass", "SELECT event_id FROM events WHERE event_id % 7 NOT IN (0, 1, 4)")
def schema_pass(spark, d):
    return integrity.SchemaEnforcer((V1, V2)).apply(_varied(spark, d)).main.select(F.col("event_seq").alias("event_id"))


@query(
    "schema_violations",
    """SELECT 'SCHEMA_VIOLATION' AS error_type, CASE event_id % 7
      WHEN 0 THEN '[v2] k expected NUMBER but got STRING, missing required field: z; [v1] k expected NUMBER but got STRING'
      WHEN 1 THEN '[v2] missing required field: k, missing required field: z; [v1] missing required field: k'
      ELSE '[v2] payload is null; [v1] payload is null' END AS error_message FROM events WHERE event_id % 7 IN (0, 1, 4)""",
)
def schema_violations(spark, d):
    return integrity.SchemaEnforcer((V1, V2)).apply(_varied(spark, d)).dlq.select("error_type", "error_message")


@query("schema_strict", """SELECT event_id, CASE event_id % 7 WHEN 0 THEN '[v1] k expected NUMBER but got STRING' WHEN 1 THEN '[v1] missing required field: k, unknown field: q'
    WHEN 2 THEN '[v1] unknown field: extra' WHEN 3 THEN '[v1] unknown field: z' WHEN 4 THEN '[v1] payload is null' END AS violations FROM events""")
def schema_strict(spark, d):
    s = integrity.SchemaEnforcer((integrity.SchemaVersion({"k": "NUMBER"}, strict=True),))
    return s.checked(_varied(spark, d)).select(F.col("event_seq").alias("event_id"), F.col("_violations").alias("violations"))


RULES = integrity.ConstraintEnforcer((integrity.NotNullRule("k"), integrity.RangeRule("k", 10, 90), integrity.FormatRule("z", "[a-z]")))
_K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"
_RULES_SQL = f"""CASE event_id % 7 WHEN 0 THEN 'k is not a number' WHEN 1 THEN 'k must not be null' WHEN 2 THEN 'k must be between 10 and 90'
  WHEN 3 THEN 'k must be between 10 and 90' WHEN 4 THEN 'k must not be null' ELSE CASE WHEN {_K} NOT BETWEEN 10 AND 90 THEN 'k must be between 10 and 90' END END"""


@query("constraint_pass", f"SELECT event_id FROM (SELECT event_id, {_RULES_SQL} AS v FROM events) WHERE v IS NULL")
def constraint_pass(spark, d):
    return RULES.apply(_varied(spark, d)).main.select(F.col("event_seq").alias("event_id"))


@query("constraint_violations", f"SELECT 'CONSTRAINT_VIOLATION' AS error_type, v AS error_message FROM (SELECT {_RULES_SQL} AS v FROM events) WHERE v IS NOT NULL")
def constraint_violations(spark, d):
    return RULES.apply(_varied(spark, d)).dlq.select("error_type", "error_message")


@query("format_rule", "SELECT o_orderkey, CASE WHEN NOT regexp_full_match(o_orderpriority, '[1-3]-[A-Z ]+') THEN 'p does not match format: [1-3]-[A-Z ]+' END AS violation FROM orders")
def format_rule(spark, d):
    o = load(spark, d, "orders").withColumn("payload_json", F.to_json(F.struct(F.col("o_orderpriority").alias("p"))))
    return integrity.ConstraintEnforcer((integrity.FormatRule("p", "[1-3]-[A-Z ]+"),)).checked(o).select("o_orderkey", F.col("_violations").alias("violation"))


# --- joins ---------------------------------------------------------------------------

def _pairs(how: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        e = env(spark, d)
        left, right = e.where("operation = 'signup'"), e.where("operation = 'purchase'")
        return enrich.DynamicJoiner("primary_key", "primary_key", how, 6 * HOUR)(left, right).select(F.col("event_seq").alias("l_id"), F.col("r_event_seq").alias("r_id"))

    return run


for _name, _how, _sql in (("join_inner", "INNER", "JOIN"), ("join_left", "LEFT", "LEFT JOIN"), ("join_right", "RIGHT", "RIGHT JOIN"), ("join_full", "FULL_OUTER", "FULL JOIN")):
    query(_name, f"""SELECT l.event_id AS l_id, r.event_id AS r_id FROM (SELECT * FROM events WHERE event_type = 'signup') l
      {_sql} (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND r.ts > l.ts - INTERVAL 6 HOUR AND r.ts < l.ts + INTERVAL 6 HOUR""")(_pairs(_how))


@query("join_orders_lineitem_left", "SELECT o_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def join_orders_lineitem_left(spark, d):
    o, li = load(spark, d, "orders"), load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return o.select("o_orderkey").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")


@query("enrich_latest", "SELECT event_id, c_name FROM events LEFT JOIN (SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY 1) ON user_id % 30 = c_nationkey")
def enrich_latest(spark, d):
    e = load(spark, d, "events").withColumn("nation", (F.col("user_id") % 30).cast("int"))
    c = load(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    return enrich.StaticJoiner("nation", "c_nationkey", ("c_custkey",))(e, c).select("event_id", F.col("ref_c_name").alias("c_name"))


@query("enrich_asof", """SELECT m.event_id, r.event_id AS ref_id FROM (SELECT * FROM events WHERE event_type = 'click') m
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON m.user_id = r.user_id AND m.ts >= r.ts""")
def enrich_asof(spark, d):
    e = load(spark, d, "events")
    r = enrich.as_of_join(e.where("event_type = 'click'"), e.where("event_type = 'signup'"), "user_id", "user_id", "ts", "ts")
    return r.select("event_id", F.col("ref_event_id").alias("ref_id"))


@query("enrich_two_refs", """SELECT event_id, c_mktsegment AS ref1, n_name AS ref2 FROM events LEFT JOIN customer ON user_id = c_custkey LEFT JOIN nation ON CAST(user_id % 40 AS INTEGER) = n_nationkey""")
def enrich_two_refs(spark, d):
    e = env(spark, d).withColumn("nation", (F.col("primary_key").cast("long") % 40).cast("string"))
    c = load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("primary_key"), F.col("c_mktsegment").alias("payload_json"))
    n = load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("payload_json"))
    e = enrich.static_join_as_metadata(e, c, "enrichedRef1", order=())
    e = enrich.static_join_as_metadata(e, n, "enrichedRef2", "nation", "k", order=())
    return e.select(F.col("event_seq").alias("event_id"), F.col("metadata")["enrichedRef1"].alias("ref1"), F.col("metadata")["enrichedRef2"].alias("ref2"))


# --- flow ----------------------------------------------------------------------------

def _splitter(copy: bool) -> flow.ParallelSplitter:
    return flow.ParallelSplitter(copy).route("orders", F.col("source") == "orders").route("early", F.col("event_seq") < 5000).route("payments", F.col("source") == "payments")


@query("route_exclusive", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'orders' WHEN event_id < 5000 THEN 'early' WHEN event_type = 'purchase' THEN 'payments' ELSE 'main' END AS route FROM events""")
def route_exclusive(spark, d):
    r = _splitter(False).apply(env(spark, d))
    tag = lambda df, n: df.select(F.col("event_seq").alias("event_id"), F.lit(n).alias("route"))
    return flow.union(tag(r.main, "main"), *[tag(s, n) for n, s in r.sides.items()])


@query("route_copy", """SELECT event_id, 'main' AS route FROM events UNION ALL SELECT event_id, 'orders' FROM events WHERE event_type = 'signup'
    UNION ALL SELECT event_id, 'early' FROM events WHERE event_id < 5000 UNION ALL SELECT event_id, 'payments' FROM events WHERE event_type = 'purchase'""")
def route_copy(spark, d):
    r = _splitter(True).apply(env(spark, d))
    tag = lambda df, n: df.select(F.col("event_seq").alias("event_id"), F.lit(n).alias("route"))
    return flow.union(tag(r.main, "main"), *[tag(s, n) for n, s in r.sides.items()])


@query("fanin_tagged", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'orders' ELSE 'payments' END AS tag FROM events WHERE event_type IN ('signup', 'purchase')")
def fanin_tagged(spark, d):
    e = env(spark, d)
    f = flow.WatermarkAlignedFanIn("5 seconds", tag=flow.tag_metadata())
    f.source("orders", e.where("source = 'orders'")).source("payments", e.where("source = 'payments'"))
    return f.merge().select(F.col("event_seq").alias("event_id"), F.col("metadata")["ingestSource"].alias("tag"))


# --- observation ---------------------------------------------------------------------

@query("silence_alerts", """SELECT user_id AS key, ts + INTERVAL 24 HOUR AS disrupted_at, nxt AS recovered_at FROM
    (SELECT CAST(user_id AS VARCHAR) AS user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt - ts > INTERVAL 24 HOUR""")
def silence_alerts(spark, d):
    a = observe.FlowDisruptionDetector("primary_key", 24 * HOUR).alerts(env(spark, d))
    return a.select("key", naive("disrupted_at"), naive("recovered_at"))


@query("latency_stats", f"SELECT count(*) AS n, count(*) FILTER ({_K} * 1000 > 50000) AS alerts, CAST(max({_K} * 1000) AS BIGINT) AS worst_ms FROM events")
def latency_stats(spark, d):
    late = F.col("event_time") + F.make_dt_interval(secs=F.get_json_object("payload_json", "$.k").cast("int"))
    ms = observe.LatencyDetector(50_000, now=late).latency_ms()
    return env(spark, d).agg(F.count("*").alias("n"), F.count_if(ms > 50_000).alias("alerts"), F.max(ms).alias("worst_ms"))


@query("observer_counts", "SELECT count(*) AS total_events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value > 100) AS large FROM events")
def observer_counts(spark, d):
    e = load(spark, d, "events")
    return observe.OnlineObserver((observe.QualityCheck("errors", F.col("event_type") == "error"), observe.QualityCheck("large", F.col("value") > 100))).counts(e)


@query("decorate_metadata", "SELECT event_id, event_type AS existing, 'pre-sink' AS task_name, CAST(4 AS BIGINT) AS n_keys FROM events")
def decorate_metadata(spark, d):
    e = env(spark, d).withColumn("metadata", F.create_map(F.lit("existing"), F.col("operation")))
    r = observe.MetadataDecorator("pre-sink").apply(e).main
    m = F.col("metadata")
    return r.select(F.col("event_seq").alias("event_id"), m["existing"].alias("existing"), m["stage.pre-sink.taskName"].alias("task_name"), F.size("metadata").cast("long").alias("n_keys"))


# --- state and sessions --------------------------------------------------------------

def _deleted() -> Column:
    return F.col("operation") == "error"


def _changelog_sql(ttl: bool) -> str:
    live = "prev IS NOT NULL AND prev_type <> 'error'" + (" AND ts < prev_ts + INTERVAL 24 HOUR" if ttl else "")
    return f"""SELECT CASE WHEN event_type = 'error' THEN 'DELETE' WHEN {live} THEN 'UPDATE' ELSE 'INSERT' END AS change_type, CAST(user_id AS VARCHAR) AS key,
      CASE WHEN {live} THEN prev END AS before_id, CASE WHEN event_type <> 'error' THEN event_id END AS after_id, ts AS at
      FROM (SELECT *, lag(event_id) OVER w AS prev, lag(event_type) OVER w AS prev_type, lag(ts) OVER w AS prev_ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _changelog(spark: SparkSession, d: str, ttl: int | None) -> DataFrame:
    c = stateful.Materializer(ttl_ms=ttl, delete=_deleted()).apply(env(spark, d)).main
    return c.select("change_type", "key", F.col("before.event_seq").alias("before_id"), F.col("after.event_seq").alias("after_id"), naive("timestamp", "at"))


@query("changelog", _changelog_sql(False))
def changelog(spark, d):
    return _changelog(spark, d, None)


@query("changelog_ttl", _changelog_sql(True))
def changelog_ttl(spark, d):
    return _changelog(spark, d, 24 * HOUR)


@query("changelog_merge", """SELECT CASE WHEN row_number() OVER w = 1 THEN 'INSERT' ELSE 'UPDATE' END AS change_type, CAST(user_id AS VARCHAR) AS key,
    string_agg(event_type, '+') OVER w AS merged FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def changelog_merge(spark, d):
    cols = model.FIELDS
    merge = lambda a, x: F.struct(*[(F.concat(a["operation"], F.lit("+"), x["operation"]) if c == "operation" else x[c]).alias(c) for c in cols])
    c = stateful.Materializer(merge=merge).apply(env(spark, d)).main
    return c.select("change_type", "key", F.col("after.operation").alias("merged"))


@query("current_state", "SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def current_state(spark, d):
    return stateful.current_state(env(spark, d), delete=_deleted()).select(F.col("primary_key").alias("key"), F.col("event_seq").alias("event_id"))


_SESSIONS = """s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM
    (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= ts - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events)),
  g AS (SELECT CAST(user_id AS VARCHAR) AS key, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS event_count,
    string_agg(event_type, ',' ORDER BY ts, event_id) AS actions FROM s GROUP BY user_id, sid)"""


@query("session_basic", f"WITH {_SESSIONS} SELECT key, session_start, session_end, event_count, CAST((epoch_us(session_end) - epoch_us(session_start)) // 1000 AS BIGINT) AS duration_ms, actions FROM g")
def session_basic(spark, d):
    r = stateful.SessionAnalyzer(gap_ms=6 * HOUR, result=stateful.actions_result()).apply(env(spark, d)).main
    return r.select("key", naive("session_start"), naive("session_end"), F.col("event_count").cast("long").alias("event_count"), "duration_ms", F.get_json_object("result", "$.actions").alias("actions"))


_ENVELOPE_SQL = f"""WITH {_SESSIONS} SELECT 'SESSION_CLOSED' AS operation, 'session-analyzer' AS source, '_id' AS primary_key, session_start AS event_time, key AS id, actions,
    CAST(event_count AS VARCHAR) AS count, CAST(event_count AS VARCHAR) AS meta_count FROM g"""


def _session_fields(r: DataFrame) -> DataFrame:
    p = lambda f: F.get_json_object("payload_json", f"$.{f}")
    return r.select("operation", "source", "primary_key", naive("event_time"), p("_id").alias("id"), p("actions").alias("actions"), p("count").alias("count"), F.col("metadata")["eventCount"].alias("meta_count"))


@query("session_envelope", _ENVELOPE_SQL)
def session_envelope(spark, d):
    r = stateful.SessionAnalyzer(gap_ms=6 * HOUR, result=stateful.actions_result()).apply(env(spark, d)).main
    return _session_fields(parse.session_to_envelope(r))


# --- sinks ---------------------------------------------------------------------------

@query("tombstone", "SELECT CAST(user_id AS VARCHAR) AS key, event_type = 'error' AS tombstone FROM events")
def tombstone(spark, d):
    e = env(spark, d).withColumn("operation", F.when(_deleted(), "Delete").otherwise(F.col("operation")))
    r = sinks.BrokerSink("t", compacted=True).records(e)
    return r.select(F.col("key").cast("string").alias("key"), F.col("value").isNull().alias("tombstone"))


@query("upsert_final", "SELECT CAST(user_id AS VARCHAR) AS key, props AS document FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'")
def upsert_final(spark, d):
    e = env(spark, d).withColumn("operation", F.when(_deleted(), "DELETE").otherwise(F.col("operation")))
    return sinks.UpsertSink().merged(None, e)


@query("search_documents", "SELECT 'trace-' || event_id AS id, event_type AS operation FROM events WHERE event_id % 5 <> 0")
def search_documents(spark, d):
    e = env(spark, d).withColumn("trace_id", F.when(F.col("event_seq") % 5 != 0, F.col("trace_id")).otherwise(" "))
    return sinks.SearchSink().documents(e).select("id", F.get_json_object("body", "$.operation").alias("operation"))


# --- jobs ----------------------------------------------------------------------------

@query("job_mongo_to_kafka", """WITH RECURSIVE c AS (SELECT event_id, user_id AS k, ts, CASE event_id % 6 WHEN 0 THEN 'insert' WHEN 1 THEN 'update' WHEN 2 THEN 'delete' WHEN 3 THEN 'insert' WHEN 4 THEN 'update' ELSE 'unknown' END AS op,
      CASE event_id % 6 WHEN 1 THEN 'age' || (event_id % 90) WHEN 2 THEN '' ELSE 'v' || event_id END AS body, date_trunc('second', ts) AS t, event_id % 1000 AS seq FROM events),
    o AS (SELECT *, op || ':' || body AS s, row_number() OVER (PARTITION BY k ORDER BY t, seq) AS n FROM c WHERE op <> 'unknown'),
    r AS (SELECT k, event_id, op, n, t AS anchor, s, true AS pass FROM o WHERE n = 1 UNION ALL
      SELECT o.k, o.event_id, o.op, o.n, CASE WHEN o.t >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s THEN o.t ELSE r.anchor END, CASE WHEN o.t >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s THEN o.s ELSE r.s END,
        o.t >= r.anchor + INTERVAL 24 HOUR OR o.s <> r.s FROM r JOIN o ON o.k = r.k AND o.n = r.n + 1)
    SELECT CAST(k AS VARCHAR) AS primary_key, op AS operation, CAST(event_id % 1000 AS BIGINT) AS event_seq FROM r WHERE pass""")
def job_mongo_to_kafka(spark, d):
    return jobs.cdc_to_broker(_changes(spark, d)).main.select("primary_key", "operation", "event_seq")


@query("job_kafka_to_mongo", """SELECT e.event_id, c_mktsegment AS ref1 FROM events e LEFT JOIN customer ON user_id = c_custkey WHERE event_id % 4 <> 0""")
def job_kafka_to_mongo(spark, d):
    e = env(spark, d).withColumn("payload_json", F.when(F.col("event_seq") % 4 != 0, F.concat(F.lit('{"_id":'), "primary_key", F.lit("}"))).otherwise(F.col("payload_json")))
    c = model.conform(load(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("primary_key"), F.col("c_mktsegment").alias("payload_json")))
    r = jobs.broker_to_documents(e, c).main
    return r.select(F.col("event_seq").alias("event_id"), F.col("metadata")["enrichedRef1"].alias("ref1"))


@query("job_merged_ingest", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'orders' ELSE 'payments' END AS tag FROM events WHERE event_type IN ('signup', 'purchase')")
def job_merged_ingest(spark, d):
    e = env(spark, d)
    r = jobs.merged_ingest(e.where("source = 'orders'"), e.where("source = 'payments'")).main
    return r.select(F.col("event_seq").alias("event_id"), F.col("metadata")["ingestSource"].alias("tag"))


@query("job_order_payments", """SELECT l.event_id, r.props AS payment_payload, CASE WHEN r.event_id IS NOT NULL THEN 'payments' END AS payment_source FROM (SELECT * FROM events WHERE event_type = 'signup') l
    LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') r ON l.user_id = r.user_id AND r.ts > l.ts - INTERVAL 6 HOUR AND r.ts < l.ts + INTERVAL 6 HOUR""")
def job_order_payments(spark, d):
    e = env(spark, d)
    r = jobs.order_payments(e.where("source = 'orders'"), e.where("source = 'payments'"), 6 * HOUR).main
    return r.select(F.col("event_seq").alias("event_id"), F.col("metadata")["paymentPayload"].alias("payment_payload"), F.col("metadata")["paymentSource"].alias("payment_source"))


@query("job_user_state", f"SELECT 'CHANGELOG_' || change_type AS operation, key AS primary_key, key AS id, change_type, before_id IS NOT NULL AS has_before, after_id IS NOT NULL AS has_after, c.at AS event_time FROM ({_changelog_sql(True)}) c")
def job_user_state(spark, d):
    r = jobs.user_state(env(spark, d), delete=_deleted()).main
    p = lambda f: F.get_json_object("payload_json", f"$.{f}")
    return r.select("operation", "primary_key", p("_id").alias("id"), p("changeType").alias("change_type"), p("before").isNotNull().alias("has_before"), p("after").isNotNull().alias("has_after"), naive("event_time"))


@query("job_event_router", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'orders' WHEN 'purchase' THEN 'payments' ELSE 'main' END AS route FROM events")
def job_event_router(spark, d):
    r = jobs.event_router(env(spark, d))
    tag = lambda df, n: df.select(F.col("event_seq").alias("event_id"), F.lit(n).alias("route"))
    return flow.union(tag(r.main, "main"), *[tag(s, n) for n, s in r.sides.items()])


@query("job_user_sessions", _ENVELOPE_SQL)
def job_user_sessions(spark, d):
    return _session_fields(jobs.user_sessions(env(spark, d), 6 * HOUR).main)
