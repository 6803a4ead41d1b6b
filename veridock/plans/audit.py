"""Registered queries of claims, audits, terms, matters and drawings. Each with DuckDB SQL over the same whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridock.operators import audit
from veridock.plans.relational import t

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return keep


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN 'FAILED' WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey % 3 <> 0 THEN 'PASS' ELSE 'NOT_VERIFIED' END status FROM orders""")
def audit_gate(spark, sf):
    disposition = F.when(F.col("o_orderstatus") == "P", "REJECT").when(F.col("o_orderstatus") == "F", "ACCEPT").otherwise("REVISE")
    responsive = F.when(F.col("o_orderpriority") == "5-LOW", "FAIL").when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "PASS")
    complete = F.when(F.col("o_custkey") % 3 == 0, "INCOMPLETE").when(F.col("o_custkey") % 3 == 1, "COMPLETE").otherwise("NOT_APPLICABLE")
    return t(spark, sf, "orders").select("o_orderkey", audit.gate_status(disposition, responsive, complete).alias("status"))


@query("""WITH q AS (SELECT DISTINCT l_orderkey issue, l_returnflag facet FROM lineitem), s AS (SELECT DISTINCT l_orderkey issue, l_returnflag facet FROM lineitem WHERE l_linestatus = 'F' AND l_quantity > 20)
SELECT q.issue, array_to_string(list_sort(list(q.facet) FILTER (s.facet IS NOT NULL)), ',') covered, array_to_string(list_sort(list(q.facet) FILTER (s.facet IS NULL)), ',') missing FROM q LEFT JOIN s ON s.issue = q.issue AND s.facet = q.facet GROUP BY 1""")
def facet_coverage(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue"), F.col("l_returnflag").alias("facet"), F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 20), F.col("l_partkey")).alias("evidence"))
    made = audit.facet_coverage(lines, lines)
    return made.select("issue", F.when(F.size("covered") > 0, F.array_join("covered", ",")).alias("covered"), F.when(F.size("missing") > 0, F.array_join("missing", ",")).alias("missing"))


@query("""WITH r AS (SELECT DISTINCT o_custkey run, o_orderpriority facet FROM orders WHERE o_totalprice > 300000), d AS (SELECT DISTINCT o_custkey run, o_orderpriority facet FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F')
SELECT c_custkey run, CASE WHEN count(r.facet) = 0 THEN 'NOT_APPLICABLE' WHEN count(r.facet) = count(d.facet) THEN 'COMPLETE' ELSE 'INCOMPLETE' END completeness FROM customer LEFT JOIN r ON r.run = c_custkey LEFT JOIN d ON d.run = r.run AND d.facet = r.facet GROUP BY 1""")
def facet_completeness(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("facet"), "o_totalprice", "o_orderstatus")
    claims = o.select("run", "claim", "facet", (F.col("o_totalprice") > 200000).alias("cited"))
    runs = t(spark, sf, "customer").select(F.col("c_custkey").alias("run"))
    return audit.facet_completeness(runs, o.where("o_totalprice > 300000"), claims, o.where("o_orderstatus = 'F'").select("claim"))


@query("""SELECT DISTINCT o_orderkey claim, CAST(o_custkey AS VARCHAR) "number" FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE CAST(l_quantity AS INT) = o_custkey)""")
def unsupported_numbers(spark, sf):
    """A claim names its customer's number; the lines it cites name quantities."""
    o, lines = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    claims = o.select(F.col("o_orderkey").alias("claim"), F.concat(F.lit("the value is "), F.col("o_custkey").cast("string"), F.lit(" m")).alias("text"))
    pairs = lines.select(F.col("l_orderkey").alias("claim"), F.col("l_quantity").cast("int").alias("source"))
    sources = lines.select(F.col("l_quantity").cast("int").alias("source")).distinct().withColumn("text", F.concat(F.lit("quantity "), F.col("source").cast("string"), F.lit(" pieces")))
    return audit.unsupported_numbers(claims, pairs, sources)


@query("""WITH c AS (SELECT c_custkey claim FROM customer WHERE c_custkey % 10 <> 0), a AS (SELECT user_id claim, count(*) n, bool_and(event_type IN ('view', 'click', 'purchase', 'signup')) known FROM events GROUP BY 1)
SELECT coalesce(c.claim, a.claim) claim, CASE WHEN n IS NULL THEN 'AUDIT_MISSING' WHEN c.claim IS NULL THEN 'UNKNOWN_CLAIM' WHEN n > 1 THEN 'AUDIT_DUPLICATE' ELSE 'UNKNOWN_DISPOSITION' END code FROM c FULL JOIN a ON a.claim = c.claim WHERE n IS NULL OR c.claim IS NULL OR n > 1 OR NOT known""")
def audit_errors(spark, sf):
    """Every event stands for an audit of its user."""
    kind = F.when(F.col("event_type").isin("view", "click"), "ACCEPT").when(F.col("event_type") == "purchase", "REVISE").when(F.col("event_type") == "signup", "REJECT").otherwise("OTHER")
    audits = t(spark, sf, "events").select(F.col("user_id").alias("claim"), kind.alias("disposition"))
    return audit.audit_errors(t(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("claim")), audits)


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN 'UNKNOWN_OPERATOR' WHEN 1 THEN CASE WHEN (l_quantity >= 25) = (l_returnflag = 'A') THEN 'CONFIRMED' ELSE 'WRONG_RESULT' END ELSE CASE WHEN (l_quantity < 25) = (l_returnflag = 'A') THEN 'CONFIRMED' ELSE 'WRONG_RESULT' END END state FROM lineitem""")
def comparison_states(spark, sf):
    operator = F.element_at(F.array(F.lit("near"), F.lit("gte"), F.lit("lt")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    state = audit.comparison_state(F.col("l_quantity"), operator, F.lit(25.0), F.col("l_returnflag") == "A")
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", state.alias("state"))


TERMS = """x AS (SELECT props AS text, CASE event_type WHEN 'signup' THEN 'primary' WHEN 'purchase' THEN 'approved_synonym' WHEN 'view' THEN 'user' ELSE 'llm' END origin, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 ELSE 3 END r,
CASE WHEN event_type NOT IN ('signup', 'purchase') THEN event_id % 9 END request, user_id % 5 issue, event_id ord FROM events)"""


@query(f"""WITH {TERMS} SELECT text, CASE WHEN min(r) = 0 AND count(request) > 0 THEN arg_min(origin, r) FILTER (request IS NOT NULL) ELSE arg_min(origin, r) END origin, array_to_string(list_sort(list(DISTINCT request) FILTER (request IS NOT NULL)), ',') requests, array_to_string(list_sort(list(DISTINCT issue)), ',') issues, min(ord) "first" FROM x GROUP BY 1""")
def merged_terms(spark, sf):
    kind = F.col("event_type")
    origin = F.when(kind == "signup", "primary").when(kind == "purchase", "approved_synonym").when(kind == "view", "user").otherwise("llm")
    request = F.when(~kind.isin("signup", "purchase"), F.col("event_id") % 9)
    terms = t(spark, sf, "events").select(F.col("props").alias("text"), origin.alias("origin"), request.alias("request"), (F.col("user_id") % 5).alias("issue"), F.col("event_id").alias("ord"))
    made = audit.merge_terms(terms)
    return made.select("text", "origin", F.when(F.size("requests") > 0, F.array_join("requests", ",")).alias("requests"), F.array_join("issues", ",").alias("issues"), "first")


@query("""SELECT l_partkey, l_suppkey, max(l_quantity) score, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') channels, array_to_string(list_sort(list(DISTINCT l_linenumber)), ',') issues, count(DISTINCT l_linestatus) > 1 conflict FROM lineitem GROUP BY 1, 2""")
def merged_candidates(spark, sf):
    hits = t(spark, sf, "lineitem").select("l_partkey", "l_suppkey", F.col("l_quantity").alias("score"), F.col("l_returnflag").alias("channel"), F.col("l_linenumber").alias("issue"), "l_linestatus")
    made = audit.merge_candidates(hits, ["l_partkey", "l_suppkey"], ["l_linestatus"])
    return made.select("l_partkey", "l_suppkey", "score", F.array_join("channels", ",").alias("channels"), F.array_join("issues", ",").alias("issues"), "conflict")


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY (l_returnflag = 'A') DESC, l_quantity DESC, l_linenumber, l_orderkey, l_partkey) place FROM lineitem) WHERE place <= 5""")
def nearest_sources(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    made = audit.nearest_sources(lines, "l_suppkey", F.col("l_returnflag") == "A", F.col("l_quantity"), F.col("l_linenumber"), F.col("l_orderkey"), "l_partkey")
    return made.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "place")


@query("""SELECT user_id issue, event_id request, event_type reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id, event_type, coalesce(CASE WHEN event_id % 2 = 0 THEN props END, '')) place FROM events""")
def ordered_drops(spark, sf):
    drops = t(spark, sf, "events").select(F.col("user_id").alias("issue"), F.col("event_id").alias("request"), F.col("event_type").alias("reason"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("clause"), F.lit(None).cast("string").alias("evidence"))
    return audit.ordered_drops(drops).select("issue", "request", "reason", "place")


@query("""SELECT matter, revision, n - revision refused FROM (SELECT user_id matter, count(*) n, list_reduce(list_prepend(CAST(0 AS BIGINT), list(CAST(json_extract(props, '$.k') AS BIGINT) % 3 + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END ORDER BY event_id)), lambda r, e: CASE WHEN e = r THEN r + 1 ELSE r END) revision FROM events GROUP BY 1)""")
def matter_revisions(spark, sf):
    expected = F.get_json_object("props", "$.k").cast("long") % 3 + F.when(F.col("event_type") == "view", 1).otherwise(0)
    return audit.matter_revision(t(spark, sf, "events").select(F.col("user_id").alias("matter"), F.col("event_id").alias("ord"), expected.alias("expected")))


@query("""SELECT event_id, CASE WHEN m IS NULL THEN NULL ELSE greatest(0, CAST(floor(epoch(ts)) AS BIGINT) - CAST(floor(epoch(m)) AS BIGINT)) END "wait" FROM (SELECT event_id, ts, max(ts + INTERVAL 30 MINUTE) OVER (PARTITION BY user_id ORDER BY ts, ts + INTERVAL 30 MINUTE, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) m FROM events)""")
def external_waits(spark, sf):
    stages = t(spark, sf, "events").select("event_id", "user_id", "ts", (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("done"))
    return audit.external_waits(stages, "user_id", "ts", "done").select("event_id", F.col("wait").cast("long").alias("wait"))


@query("""SELECT c_custkey run, CASE WHEN bool_or(o_orderpriority = p) THEN 'VALID' WHEN count(o_orderkey) > 0 THEN 'STALE' ELSE 'MISSING' END status FROM (SELECT c_custkey, CASE c_nationkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE 'none' END p FROM customer) LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY 1""")
def decision_binding(spark, sf):
    packet = F.when(F.col("c_nationkey") % 3 == 0, "1-URGENT").when(F.col("c_nationkey") % 3 == 1, "2-HIGH").otherwise("none")
    runs = t(spark, sf, "customer").select(F.col("c_custkey").alias("run"), packet.alias("packet"))
    return audit.binding_status(runs, t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("run"), F.col("o_orderpriority").alias("packet")))


@query("""SELECT l_suppkey drawing, l_returnflag axis, round(avg(x), 6) scale, max(x) <= avg(x) * 1.5 AND min(x) >= avg(x) * 0.5 agrees FROM (SELECT *, l_extendedprice / l_quantity x FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0) GROUP BY 1, 2""")
def drawing_calibration(spark, sf):
    refs = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("drawing"), F.col("l_returnflag").alias("axis"), F.col("l_quantity").alias("pixels"), F.col("l_extendedprice").alias("real"))
    return audit.calibration(refs, F.lit(0.5)).select("drawing", "axis", F.round("scale", 6).alias("scale"), "agrees")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN least(w, h) < 5 THEN 'LOW_RESOLUTION' END, CASE WHEN w * h > 1500 THEN 'TOO_MANY_PIXELS' END, CASE WHEN total > 3000 THEN 'CASE_PIXEL_LIMIT' END], lambda x: x IS NOT NULL), ',') reasons, CASE WHEN w * h > 1500 OR total > 3000 THEN 'REJECTED' WHEN least(w, h) < 5 THEN 'REVIEW' ELSE 'PASS' END quality
FROM (SELECT *, sum(w * h) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) total FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INT) w, CAST(50 - l_quantity AS INT) + 10 h FROM lineitem))""")
def drawing_quality(spark, sf):
    pages = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("width"), ((50 - F.col("l_quantity")).cast("int") + 10).alias("height"))
    made = audit.drawing_quality(pages, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "width"], 5, 1500, 3000)
    return made.drop("width", "height")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' WHEN o_orderpriority = '5-LOW' THEN 'BLOCKED' WHEN o_totalprice < 50000 THEN 'AWAITING_CONFIRMATION' WHEN o_orderstatus = 'F' THEN 'READY_TO_EVALUATE' ELSE 'RECEIVED' END state FROM orders""")
def drawing_states(spark, sf):
    flags = {"FAILED": F.col("o_orderstatus") == "P", "BLOCKED": F.col("o_orderpriority") == "5-LOW", "AWAITING_CONFIRMATION": F.col("o_totalprice") < 50000, "READY_TO_EVALUATE": F.col("o_orderstatus") == "F"}
    return t(spark, sf, "orders").select("o_orderkey", audit.drawing_state(flags).alias("state"))


@query("""SELECT l_orderkey issue FROM lineitem GROUP BY 1 HAVING bool_or(l_quantity > 40 AND l_discount > 0.02) AND bool_and(l_quantity <= 40 OR l_discount > 0.02)""")
def conditional_issues(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue"), (F.col("l_quantity") <= 40).alias("normal"), (F.col("l_discount") > 0.02).alias("conditional"))
    return audit.conditional_issues(lines)
