"""Registered queries of retrieval and review: search, fusion, graph, budgets, coverage, rules, formulas. Each with DuckDB SQL where it can be."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.functions import geometry, numbers, text
from veridock.functions.canonical import canonical_json, content_id
from veridock.operators import budgets, graph, review, rules, search, segments
from veridock.plans.relational import t
from veridock.sources import evidence

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Token array of a text in DuckDB.
TOK = r"list_filter(regexp_split_to_array(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
BODY = f"' ' || array_to_string({TOK}, ' ') || ' '"


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def _docs(spark, sf) -> DataFrame:
    return t(spark, sf, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, n FROM (SELECT doc_id, len({TOK}) n, {TOK} w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'was') AND list_contains(w, 'from') ORDER BY n, doc_id LIMIT 25")
def fts_token_and(spark, sf):
    base = _docs(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("__t"))
    return base.where(search.has_tokens(F.col("__t"), ["the", "was", "from"])).select("doc_id", F.size("__t").alias("n")).orderBy("n", "doc_id").limit(25)


@query(f"SELECT doc_id, n FROM (SELECT doc_id, len({TOK}) n, {TOK} w FROM documents) WHERE len(list_filter(w, lambda x: starts_with(x, 'thro'))) > 0 OR (len(list_filter(w, lambda x: starts_with(x, 'onin'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'reth'))) > 0) ORDER BY n, doc_id LIMIT 25")
def fts_prefix_and(spark, sf):
    base = _docs(spark, sf).select("doc_id", text.tokens(F.col("text")).alias("__t"))
    test = search.has_prefixes(F.col("__t"), ["thro"]) | search.has_prefixes(F.col("__t"), ["onin", "reth"])
    return base.where(test).select("doc_id", F.size("__t").alias("n")).orderBy("n", "doc_id").limit(25)


@query(f"SELECT doc_id FROM documents WHERE contains({BODY}, ' of the ') AND contains({BODY}, ' to the ')")
def fts_phrase(spark, sf):
    return _docs(spark, sf).where(search.has_phrase(F.col("text"), ["of", "the"]) & search.has_phrase(F.col("text"), ["to", "the"])).select("doc_id")


@query(f"SELECT term, sum(tf) n, count(*) df FROM (SELECT doc_id, term, count(*) tf FROM (SELECT doc_id, unnest({TOK}) term FROM documents) GROUP BY 1, 2) GROUP BY 1 HAVING count(*) > 5")
def postings_terms(spark, sf):
    return search.postings(_docs(spark, sf), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("n"), F.count(F.lit(1)).alias("df")).where("df > 5")


BM25 = f"""WITH d AS (SELECT doc_id, {TOK} w FROM documents), s AS (SELECT count(*) n, avg(len(w)) avgdl FROM d), q AS (SELECT unnest(['the', 'was', 'this']) term),
tf AS (SELECT doc_id, len(w) dl, term, len(list_filter(w, lambda x: x = term)) f FROM d, q), df AS (SELECT term, count_if(f > 0) df FROM tf GROUP BY 1)
SELECT doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))), 12) score FROM tf JOIN df USING (term), s WHERE f > 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 20"""


@query(BM25)
def bm25_topk(spark, sf):
    return search.bm25(_docs(spark, sf), "doc_id", "text", ["the", "was", "this"], 20)


def _channel_sql(name: str, counts: list[str]) -> str:
    """A channel's 20 best rows: BM25 over the counts f0, f1, ... of its terms."""
    fs = ", ".join(f"{c} f{i}" for i, c in enumerate(counts))
    dfs = ", ".join(f"count_if(f{i} > 0) df{i}" for i in range(len(counts)))
    score = " + ".join(f"greatest(ln((n - df{i} + 0.5) / (df{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(counts)))
    hit = " AND ".join(f"f{i} > 0" for i in range(len(counts)))
    return f"""SELECT * FROM (SELECT doc_id, '{name}' c, row_number() OVER (ORDER BY round({score}, 12) DESC, doc_id) r
FROM (SELECT doc_id, len(w) dl, {fs} FROM d) x, (SELECT count(*) n, avg(dl) avgdl, {dfs} FROM (SELECT len(w) dl, {fs} FROM d)) y WHERE {hit}) WHERE r <= 20"""


CHANNELS = " UNION ALL ".join((
    _channel_sql("fts_phrase", ["len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'))"]),
    _channel_sql("fts_token_and", ["len(list_filter(w, lambda x: x = 'of'))", "len(list_filter(w, lambda x: x = 'the'))"]),
    _channel_sql("fts_token_prefix_and", ["len(list_filter(w, lambda x: starts_with(x, 'of')))", "len(list_filter(w, lambda x: starts_with(x, 'the')))"]),
))


@query(f"""WITH d AS (SELECT doc_id, {TOK} w FROM documents), h AS ({CHANNELS})
SELECT doc_id, round(sum((1.0 / r) * CASE c WHEN 'fts_phrase' THEN 0.55 WHEN 'fts_token_and' THEN 0.15 ELSE 0.12 END), 6) final_score, string_agg(c, '|' ORDER BY c) channels FROM h GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""")
def reciprocal_rank_fusion(spark, sf):
    hits = search.channels(_docs(spark, sf), "doc_id", "text", ["of", "the"], ("fts_phrase", "fts_token_and", "fts_token_prefix_and"), 20)
    return search.fuse(hits, "doc_id").orderBy(F.desc("final_score"), "doc_id").limit(20)


@query("""SELECT user_id, event_type channel, max(value) score, array_to_string(list_sort(list(DISTINCT props)), ' | ') detail FROM events GROUP BY 1, 2""")
def merged_channels(spark, sf):
    hits = t(spark, sf, "events").select("user_id", F.col("event_type").alias("channel"), F.col("value").alias("score"), F.col("props").alias("detail"))
    return search.merge_details(hits, "user_id")


@query(f"""WITH i AS (SELECT item_id, {TOK} w, len({TOK}) n FROM benchmark),
v AS (SELECT item_id, list_concat(CASE WHEN n >= 2 THEN [w[k] || w[k + 1] FOR k IN range(1, n)] ELSE [] END, CASE WHEN n >= 3 THEN [w[k] || w[k + 1] || w[k + 2] FOR k IN range(1, n - 1)] ELSE [] END) c,
list_concat(CASE WHEN n >= 3 THEN [array_to_string(list_concat(w[1:k - 1], w[k + 1:]), ' ') FOR k IN range(1, n + 1)] ELSE [] END, CASE WHEN n > 3 THEN [array_to_string(w[k:k + 2], ' ') FOR k IN range(1, n - 1)] ELSE [] END, CASE WHEN n > 2 THEN [array_to_string(w[k:k + 1], ' ') FOR k IN range(1, n)] ELSE [] END) s FROM i)
SELECT item_id, list_filter(c, lambda x, k: list_position(c, x) = k) compounds, list_filter(s, lambda x, k: list_position(s, x) = k)[1:10] sub_queries FROM v""")
def query_variants(spark, sf):
    """Compounds and sub-queries of each benchmark item."""
    words = text.tokens(F.col("text"))
    return t(spark, sf, "benchmark").select("item_id", text.compounds(words).alias("compounds"), text.sub_queries(words).alias("sub_queries"))


EDGES = """e AS (SELECT 'c' || o_custkey source, 'o' || o_orderkey target, CASE o_orderstatus WHEN 'F' THEN 'exception' WHEN 'O' THEN 'parent' ELSE 'table' END relation, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 7 END pr FROM orders
UNION ALL SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey, 'cited_clause', 3 FROM lineitem),
k AS (SELECT 'o' || o_orderkey node FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT 'p' || p_partkey FROM part WHERE p_partkey % 7 <> 0),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pr, target) slot FROM e) WHERE slot <= 6)"""


@query(f"""WITH {EDGES}, s AS (SELECT 'c' || c_custkey node, c_custkey qid FROM customer),
l1 AS (SELECT qid, target, source, relation, slot, target IN (SELECT node FROM k) found FROM s JOIN f ON f.source = s.node),
b1 AS (SELECT *, coalesce(sum(found::INT) OVER (PARTITION BY qid ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bf FROM l1), k1 AS (SELECT * FROM b1 WHERE bf < 12),
fr AS (SELECT qid, target source, row_number() OVER (PARTITION BY qid ORDER BY slot) turn FROM k1 WHERE found), u AS (SELECT qid, count_if(found) used FROM k1 GROUP BY 1),
x2 AS (SELECT fr.qid, f.target, f.source, f.relation, fr.turn, f.slot, row_number() OVER (PARTITION BY fr.qid, f.target ORDER BY fr.turn, f.slot) seen FROM fr JOIN f ON f.source = fr.source),
l2 AS (SELECT qid, target, source, relation, turn, slot, target IN (SELECT node FROM k) found FROM x2 WHERE seen = 1 AND (qid, target) NOT IN (SELECT (qid, target) FROM k1)),
b2 AS (SELECT *, coalesce(sum(found::INT) OVER (PARTITION BY qid ORDER BY turn, slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) bf FROM l2)
SELECT qid "query", target, source, relation, 1 depth, found FROM k1 UNION ALL SELECT b2.qid, target, source, relation, 2, found FROM b2 JOIN u ON u.qid = b2.qid WHERE bf + used < 12""")
def bfs_budgeted(spark, sf):
    o, p = t(spark, sf, "orders"), t(spark, sf, "part")
    kind = F.when(F.col("o_orderstatus") == "F", "exception").when(F.col("o_orderstatus") == "O", "parent").otherwise("table")
    links = o.select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("o"), "o_orderkey").alias("target"), kind.alias("relation"))
    links = links.union(t(spark, sf, "lineitem").select(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"), F.lit("cited_clause")).distinct())
    known = o.where("o_orderkey % 5 <> 0").select(F.concat(F.lit("o"), "o_orderkey").alias("node")).union(p.where("p_partkey % 7 <> 0").select(F.concat(F.lit("p"), "p_partkey")))
    known = known.select("node", F.lit(True).alias("is_known"), F.lit(None).cast("string").alias("stale"))
    seeds = t(spark, sf, "customer").select(F.col("c_custkey").alias("query"), F.concat(F.lit("c"), "c_custkey").alias("node"))
    return graph.traverse(seeds, links, known, depth=2).select("query", "target", "source", "relation", "depth", "found")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id s, CAST(json_extract(props, '$.k') AS BIGINT) d FROM events), r(node) AS (SELECT DISTINCT user_id FROM events WHERE user_id % 97 = 3 UNION SELECT d FROM e JOIN r ON e.s = r.node) SELECT node FROM r""")
def transitive_staleness(spark, sf):
    """Everything that hangs on some users, along the links of all events."""
    e = t(spark, sf, "events")
    edges = e.select(F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("target")).distinct()
    return graph.closure(edges, e.where("user_id % 97 = 3").select(F.col("user_id").alias("node")))


@query("""SELECT DISTINCT user_id source, CAST(json_extract(props, '$.k') AS BIGINT) target FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)""")
def dangling_links(spark, sf):
    edges = t(spark, sf, "events").select(F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("target")).distinct()
    return graph.dangling(edges, t(spark, sf, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("node")))


REQ = """r AS (SELECT user_id issue, event_type role, CASE event_type WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3 ELSE 4 END rp, event_id request FROM events),
a AS (SELECT *, row_number() OVER (PARTITION BY issue, role ORDER BY request) depth FROM r)"""


@query(f"""WITH {REQ} SELECT issue, request, row_number() OVER (PARTITION BY issue ORDER BY depth, rp) place, row_number() OVER (PARTITION BY issue ORDER BY depth, rp) <= 4 selected FROM a""")
def issue_roundrobin_budget(spark, sf):
    pos = F.when(F.col("event_type") == "signup", 0).when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    req = t(spark, sf, "events").select(F.col("user_id").alias("issue"), F.col("event_type").alias("role"), pos.alias("role_pos"), F.col("event_id").alias("request"), F.col("event_id").alias("ord"))
    return budgets.requests_for_issues(req).select("issue", "request", "place", "selected")


@query("""WITH c AS (SELECT l_suppkey g, l_returnflag bucket, l_partkey item, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey) rank FROM lineitem),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g, item ORDER BY rank, bucket) n FROM c) WHERE n = 1)
SELECT g, item, place FROM (SELECT g, item, row_number() OVER (PARTITION BY g ORDER BY rank, bucket, item) place FROM o) WHERE place <= 80""")
def global_interleave(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_returnflag").alias("bucket"), F.col("l_partkey").alias("item"), "l_orderkey", "l_linenumber")
    ranked = segments.ordinal(lines, ["g", "bucket"], ["l_orderkey", "l_linenumber", "item"], "rank")
    return budgets.interleave(ranked, ["g"], 80).where("selected").select("g", "item", "place")


@query("""SELECT l_suppkey g, evidence, place FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY ord, evidence) place FROM (SELECT l_suppkey, l_partkey evidence, min(l_orderkey) ord FROM lineitem GROUP BY 1, 2)) WHERE place <= 40""")
def first_come_evidence(spark, sf):
    pairs = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey").alias("evidence"), F.col("l_orderkey").alias("ord"))
    return budgets.first_come(pairs, ["g"], 40).select("g", "evidence", "place")


ISSUES = """i AS (SELECT o_orderkey issue, o_custkey run, list_sort(list(DISTINCT l_returnflag)) sem, list_sort(list(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_returnflag END)) cit,
bool_or(l_quantity = 50) conf, bool_or(l_quantity = 49) amb, bool_or(l_quantity = 48) src, bool_or(l_quantity = 47) ref, bool_or(l_discount = 0.1 AND l_quantity > 40) rel, bool_or(l_tax = 0.08) cond FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
s AS (SELECT *, list_filter(cit, lambda x: x IS NOT NULL AND x IN ('A', 'N')) cov, list_filter(['A', 'N'], lambda x: NOT list_contains(list_filter(cit, lambda y: y IS NOT NULL), x)) mis FROM i),
v AS (SELECT *, CASE WHEN conf THEN 'CONFLICT' WHEN amb THEN 'UNRESOLVED' WHEN src OR ref THEN 'SOURCE_MISSING' WHEN rel THEN 'UNRESOLVED' WHEN len(mis) > 0 THEN 'UNRESOLVED' WHEN cond THEN 'CONDITIONAL' ELSE 'RESOLVED' END status,
NOT conf AND NOT amb clear FROM s),
w AS (SELECT *, clear AND NOT src AND NOT ref AND NOT rel AND len(mis) > 0 open_miss, list_has_any(mis, sem) parse FROM v),
g AS (SELECT *, array_to_string(list_filter([CASE WHEN conf THEN 'CONFLICTING_RULES' END, CASE WHEN NOT conf AND amb THEN 'AMBIGUOUS_RULE' END, CASE WHEN clear AND src THEN 'SOURCE_NOT_INGESTED' END, CASE WHEN clear AND ref THEN 'REFERENCE_TARGET_MISSING' END,
CASE WHEN open_miss AND parse THEN 'PARSE_GAP' END, CASE WHEN clear AND rel THEN 'RELEVANCE_INSUFFICIENT' END, CASE WHEN open_miss AND NOT parse THEN 'RETRIEVAL_MISS' END], lambda x: x IS NOT NULL), ',') gaps FROM w)"""


def _issues(spark, sf) -> DataFrame:
    lines, q = t(spark, sf, "lineitem"), F.col("l_quantity")
    base = t(spark, sf, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("issue"), F.col("o_custkey").alias("run")).agg(
        F.collect_set("l_returnflag").alias("semantic"), F.collect_set(F.when(F.col("l_linestatus") == "F", F.col("l_returnflag"))).alias("cited"),
        F.bool_or(q == 50).alias("conflicting"), F.bool_or(q == 49).alias("ambiguous"), F.bool_or(q == 48).alias("source_missing"), F.bool_or(q == 47).alias("reference_missing"),
        F.bool_or((F.col("l_discount") == 0.1) & (q > 40)).alias("relevance_insufficient"), F.bool_or(F.col("l_tax") == 0.08).alias("conditional"),
    )
    return review.issue_coverage(base.withColumns({"required": F.array(F.lit("A"), F.lit("N")), "missing_facets": F.array().cast("array<string>")}))


@query(f"WITH {ISSUES} SELECT issue, status, array_to_string(cov, ',') covered, array_to_string(mis, ',') missing, gaps FROM g")
def coverage_status(spark, sf):
    return _issues(spark, sf).select("issue", "status", F.array_join("covered", ",").alias("covered"), F.array_join("missing", ",").alias("missing"), F.array_join("gaps", ",").alias("gaps"))


FACTORS = """c AS (SELECT run, round(count_if(NOT regexp_matches(gaps, 'SOURCE_NOT_INGESTED|REFERENCE_TARGET_MISSING|RETRIEVAL_MISS')) / count(*), 4) source_completeness,
round(count_if(status IN ('RESOLVED','CONDITIONAL') AND len(cov) > 0 AND len(mis) = 0) / count(*), 4) traceability, round(sum(len(cov)) / sum(len(cov) + len(mis)), 4) rule_coverage,
round(count_if(status IN ('RESOLVED','CONDITIONAL') AND len(mis) = 0) / count(*), 4) input_completeness, round(count_if(NOT contains(gaps, 'PARSE_GAP')) / count(*), 4) parse_quality,
CASE WHEN count_if(status = 'CONFLICT') > 0 THEN 0 ELSE 1 END no_conflict, count_if(status IN ('RESOLVED','CONDITIONAL')) n_resolved, count(*) n_issues FROM g GROUP BY 1)"""


@query(f"WITH {ISSUES}, {FACTORS} SELECT run, CAST(source_completeness AS DOUBLE) source_completeness, CAST(traceability AS DOUBLE) traceability, CAST(rule_coverage AS DOUBLE) rule_coverage, CAST(input_completeness AS DOUBLE) input_completeness, CAST(parse_quality AS DOUBLE) parse_quality, no_conflict, n_resolved, n_issues FROM c")
def coverage_factors(spark, sf):
    made = review.coverage_factors(_issues(spark, sf), "run")
    return made.select("run", *[F.col(c).cast("double").alias(c) for c in ("source_completeness", "traceability", "rule_coverage", "input_completeness", "parse_quality")], "no_conflict", "n_resolved", "n_issues")


CONF = """(SELECT run, no_conflict, round(CAST(0.20 * source_completeness + 0.15 * traceability + 0.10 * parse_quality + 0.15 * rule_coverage + 0.15 * input_completeness + 0.05 + 0.05 + 0.02 * no_conflict AS DECIMAL(18,8)), 4) score FROM
(SELECT run, no_conflict, CAST(source_completeness AS DECIMAL(10,4)) source_completeness, CAST(traceability AS DECIMAL(10,4)) traceability, CAST(parse_quality AS DECIMAL(10,4)) parse_quality, CAST(rule_coverage AS DECIMAL(10,4)) rule_coverage, CAST(input_completeness AS DECIMAL(10,4)) input_completeness FROM c))"""


def _confidence(spark, sf) -> DataFrame:
    f = review.coverage_factors(_issues(spark, sf), "run")
    one, zero = F.lit(1).cast("decimal(10,4)"), F.lit(0).cast("decimal(10,4)")
    named = [
        ("source completeness", F.col("source_completeness"), "issue_coverage"), ("traceability", F.col("traceability"), "issue_coverage"), ("parse quality", F.col("parse_quality"), "issue_coverage"),
        ("human review status", zero, "human_review:pending"), ("rule coverage", F.col("rule_coverage"), "issue_coverage"), ("input completeness", F.col("input_completeness"), "issue_coverage"),
        ("calculation validity", one, "math"), ("Track B agreement", one, "audit"), ("source freshness", zero, "source_freshness:not_verified"), ("unresolved conflict factor", F.col("no_conflict").cast("decimal(10,4)"), "issue_coverage"),
    ]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("decimal(10,4)").alias("value"), F.lit(s).alias("source")) for n, v, s in named])
    flat = f.select("run", (F.col("no_conflict") == 0).cast("int").alias("failures"), F.explode(rows).alias("x")).select("run", "failures", "x.*")
    return review.confidence(flat, "run").join(f.select("run", "no_conflict"), "run")


@query(f"WITH {ISSUES}, {FACTORS} SELECT run, CAST(score AS DOUBLE) score, CASE WHEN no_conflict = 0 OR score < 0.70 THEN 'LOW' ELSE 'MEDIUM' END AS level FROM {CONF}")
def confidence_score(spark, sf):
    return _confidence(spark, sf).select("run", F.col("score").cast("double").alias("score"), "level")


@query(f"WITH {ISSUES}, {FACTORS} SELECT run, array_to_string(list_filter([CASE WHEN run % 7 = 0 THEN 'MISSING_REQUIRED_INPUT' END, CASE WHEN run % 5 = 0 THEN 'UNCITED_OR_UNRESOLVED_CLAIM' END, CASE WHEN run % 13 = 0 THEN 'UNAPPROVED_RULE' END, CASE WHEN run % 11 = 0 THEN 'MATH_ENGINE_ERROR' END, CASE WHEN run % 17 = 0 THEN 'SOURCE_HASH_MISMATCH' END, CASE WHEN no_conflict = 0 THEN 'UNRESOLVED_CONFLICT' END, CASE WHEN run % 19 = 0 THEN 'TRACK_B_REJECTION' END, CASE WHEN run % 23 = 0 THEN 'MACHINE_SET_HUMAN_DECISION' END, CASE WHEN run % 29 = 0 THEN 'UNREGISTERED_NUMERIC_VALUE' END, CASE WHEN score < 0.70 THEN 'LOW_CONFIDENCE' END], lambda x: x IS NOT NULL), ',') reasons FROM {CONF}")
def abstention_gates(spark, sf):
    every = {"missing_required_input": 7, "uncited_or_unresolved_claim": 5, "unapproved_rule": 13, "math_engine_error": 11, "source_hash_mismatch": 17, "track_b_rejection": 19, "machine_set_human_decision": 23, "unregistered_numeric_value": 29}
    flags = {"unresolved_conflict": F.col("no_conflict") == 0, **{name: F.col("run") % n == 0 for name, n in every.items()}}
    return _confidence(spark, sf).select("run", F.array_join(review.abstention_reasons(F.col("score"), flags), ",").alias("reasons"))


@query(f"WITH {ISSUES} SELECT run, bool_or(status IN ('RESOLVED','CONDITIONAL')) AND NOT bool_and(status IN ('RESOLVED','CONDITIONAL')) AS partial, NOT bool_or(status IN ('RESOLVED','CONDITIONAL')) abstain FROM g GROUP BY 1")
def global_abstain(spark, sf):
    return review.global_abstain(_issues(spark, sf), "run")


@query("""SELECT o_custkey run, CASE WHEN count_if(st = 'PENDING') > 0 THEN 'PENDING_REFERENCE_INGESTION' WHEN bool_or(st = 'BLOCKED') THEN 'BLOCKED' ELSE 'READY_TO_EVALUATE' END state FROM (SELECT o_custkey, CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'BLOCKED' ELSE 'OK' END st FROM orders) GROUP BY 1""")
def review_readiness(spark, sf):
    open_ = F.col("o_orderstatus") == "P"
    state = review.source_state(F.lit("REFERENCE"), F.lit(True), ~((F.col("o_orderpriority") == "5-LOW") & open_), ~((F.col("o_orderpriority") == "1-URGENT") & open_), F.lit(True), F.lit(False), F.lit(True))
    att = t(spark, sf, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("attachment"), F.lit("REFERENCE").alias("role"), state.alias("state"))
    return review.review_readiness(att, "run").select("run", "state")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 'DIVISION_BY_ZERO' ELSE 'SUCCESS' END status, CASE WHEN l_tax > 0 THEN CASE WHEN CAST(l_discount AS DECIMAL(10,4)) < CAST(l_tax AS DECIMAL(10,4)) * 2 THEN 'BELOW_THRESHOLD' WHEN CAST(l_discount AS DECIMAL(10,4)) > CAST(l_tax AS DECIMAL(10,4)) * 2 THEN 'ABOVE_THRESHOLD' ELSE 'AT_THRESHOLD' END END comparison FROM lineitem""")
def frontage_ratio(spark, sf):
    lines = t(spark, sf, "lineitem").withColumns({c: F.col(c).cast("decimal(10,4)").cast("string") for c in ("l_discount", "l_tax")}).withColumn("two", F.lit("2"))
    made = rules.run_formula(lines, "FRONTAGE_RATIO", "1", {"frontage_length_m": "l_discount", "perimeter_length_m": "l_tax", "threshold_ratio": "two"}, "calc")
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "calc.status", "calc.comparison")


def order_rule() -> rules.Rule:
    return rules.Rule(
        "ORDER-CHECK", "1", {"total": ("decimal", True), "status": ("string", True), "priority": ("string", False)},
        {"all": [
            {"compare": {"operator": "gte", "left": {"input": "total"}, "right": {"value": "100000"}}},
            {"any": [{"compare": {"operator": "eq", "left": {"input": "status"}, "right": {"value": "F"}}}, {"compare": {"operator": "in", "left": {"input": "priority"}, "right": {"value": ["1-URGENT", "2-HIGH"]}}}]},
            {"not": {"compare": {"operator": "contains", "left": {"input": "priority"}, "right": {"value": "LOW"}}}},
        ]},
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'INDETERMINATE' WHEN o_totalprice >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT contains(o_orderpriority, 'LOW') THEN 'SATISFIED' ELSE 'NOT_SATISFIED' END status,
CASE WHEN o_orderkey % 13 = 0 THEN 'MISSING_REQUIRED_INPUT' WHEN o_totalprice >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority IN ('1-URGENT', '2-HIGH')) AND NOT contains(o_orderpriority, 'LOW') THEN 'EVALUATED_TRUE' ELSE 'EVALUATED_FALSE' END reason FROM orders""")
def rule_eval(spark, sf):
    inputs = {"total": F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice").cast("decimal(18,6)")), "status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")}
    made = rules.evaluate(order_rule(), inputs)
    return t(spark, sf, "orders").select("o_orderkey", made["status"].alias("status"), made["reason"].alias("reason"))


@query("""SELECT n_nationkey context, rule_id, CASE WHEN region IS NOT NULL AND region <> r_name THEN 'REGION_MISMATCH' WHEN parity IS NOT NULL AND parity <> n_nationkey % 2 THEN 'PARITY_MISMATCH' END code FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('R1', 'ASIA', NULL), ('R2', NULL, 1), ('R3', NULL, NULL)) x(rule_id, region, parity)""")
def rule_scope_select(spark, sf):
    rule_list = spark.createDataFrame([("R1", "ASIA", None), ("R2", None, 1), ("R3", None, None)], "rule_id string, region string, parity int")
    ctx = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("context"), F.col("r_name").alias("region"), (F.col("n_nationkey") % 2).alias("parity"))
    return rules.select_rules(rule_list, ctx, ["region", "parity"])


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN true ELSE false END "within" FROM lineitem""")
def conditional_threshold(spark, sf):
    """A fact above the ordinary 25 m and within the conditional 60 m, where a discount makes the second one conditional."""
    lines = t(spark, sf, "lineitem")
    fact = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" m"))
    rule = F.when(F.col("l_discount") > 0.05, "25 m 이하. " + "가" * 90 + " 다만 60 m 까지").otherwise("25 m 이하")
    made = numbers.conditional_range(F.col("fact"), F.col("rule"))
    return lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", numbers.measures(fact).alias("fact"), numbers.measures(rule).alias("rule")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", made.alias("within"))


@query(r"""SELECT p_partkey, CAST(len(regexp_extract_all(x, '[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+')) AS INT) n, array_to_string(regexp_extract_all(x, '[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+'), '|') numbers FROM (SELECT p_partkey, p_size || ' of ' || format('{:,}', CAST(floor(p_retailprice) AS BIGINT)) x FROM part)""")
def numeric_scan(spark, sf):
    line = F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("of"), F.format_number(F.floor("p_retailprice"), 0))
    found = t(spark, sf, "part").select("p_partkey", numbers.numeric_tokens(line).alias("found"))
    return found.select("p_partkey", F.size("found").alias("n"), F.array_join(F.transform("found", lambda x: x["text"]), "|").alias("numbers"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 < 7 THEN s || ':' || (s + len(f)) || ': ' || f END refused FROM (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 5 THEN 5 ELSE 3 END s,
CASE o_orderkey % 8 WHEN 0 THEN o_orderkey || 'e3' WHEN 1 THEN '.' || o_orderkey WHEN 2 THEN o_orderkey || '_5' WHEN 3 THEN o_orderkey || ',5' WHEN 4 THEN '1' WHEN 5 THEN '' || o_orderkey WHEN 6 THEN '⑩' END f FROM orders)""")
def numeric_refusals(spark, sf):
    """The first expression of a line that looks numeric and is no number: exponents, leading dots, underscores, wrong groups, lone digits, numerals."""
    k = F.col("o_orderkey").cast("string")
    forms = [F.concat(k, F.lit("e3")), F.concat(F.lit("."), k), F.concat(k, F.lit("_5")), F.concat(k, F.lit(",5")), F.concat(F.lit("1."), k, F.lit(".3")), F.concat(F.lit("5-"), k), F.concat(F.lit("⑩"), k), k]
    line = F.concat(F.lit("at "), F.element_at(F.array(*forms), (F.col("o_orderkey") % 8 + 1).cast("int")), F.lit(" m"))
    return t(spark, sf, "orders").select("o_orderkey", numbers.unsupported_numeric(line).alias("refused"))


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 250000 THEN 'LESS' WHEN o_totalprice > 250000 THEN 'GREATER' ELSE 'EQUAL' END cmp FROM orders""")
def decimal_compare(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", numbers.compare_tokens(F.format_number("o_totalprice", 2), F.lit("250,000")).alias("cmp"))


@query("""SELECT o_orderkey, 'CALC-' || upper(sha256('{"order":"' || o_orderkey || '","status":"' || o_orderstatus || '"}')[1:20]) id FROM orders""")
def content_ids(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", content_id("CALC-", canonical_json(status=F.col("o_orderstatus"), order=F.col("o_orderkey").cast("string"))).alias("id"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_linenumber % 4 WHEN 1 THEN l_quantity WHEN 2 THEN 200 - (l_quantity + 20) WHEN 3 THEN 200 - (l_quantity + 10) ELSE l_quantity END "left", CASE l_linenumber % 4 WHEN 1 THEN l_quantity WHEN 2 THEN l_quantity WHEN 3 THEN 100 - (l_quantity + 20) ELSE 100 - (l_quantity + 10) END bottom,
CASE l_linenumber % 4 WHEN 1 THEN l_quantity + 10 WHEN 2 THEN 200 - l_quantity WHEN 3 THEN 200 - l_quantity ELSE l_quantity + 20 END "right", CASE l_linenumber % 4 WHEN 1 THEN l_quantity + 20 WHEN 2 THEN l_quantity + 10 WHEN 3 THEN 100 - l_quantity ELSE 100 - l_quantity END top FROM lineitem""")
def box_normalisation(spark, sf):
    """Boxes of pages in all four rotations."""
    q = F.col("l_quantity")
    b = F.struct(q.alias("left"), q.alias("bottom"), (q + 20).alias("right"), (q + 10).alias("top"))
    made = geometry.normalize_box(b, F.lit(200.0), F.lit(100.0), F.col("l_linenumber") % 4 * 90)
    return t(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", made.alias("b")).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "b.left", "b.bottom", "b.right", "b.top")


@query(r"""SELECT doc_id, "segment", string_agg(line, chr(10) ORDER BY pos) "text", CAST(count(*) AS BIGINT) n_rows FROM (SELECT *, CAST(sum(CASE WHEN len(string_split(line, ' ')) <= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) "segment" FROM (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) pos FROM documents)) GROUP BY 1, 2""")
def clause_segmentation(spark, sf):
    """Short lines open a section; the following lines belong to it."""
    lines = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    marked = segments.segment(lines, ["doc_id"], "pos", F.size(F.split("line", " ")) <= 4)
    return segments.fold_segments(marked, ["doc_id"], "pos", "line").select("doc_id", "segment", "text", "n_rows")


@query(r"""WITH b AS (SELECT page_id, regexp_replace(html, '<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'gis') h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(h, '<(/?)(title|h1|h2|h3|p|li|td)\b[^>]*>', chr(1) || '\1\2' || chr(2), 'gis'), '<br\b[^>]*>', ' ', 'gis'), '<[^>]*>', '', 'g') h FROM b),
e AS (SELECT page_id, list_filter(string_split(h, chr(1)), lambda x: contains(x, chr(2)) AND NOT starts_with(x, '/')) l FROM m)
SELECT page_id, CAST(o AS INT) ordinal, lower(string_split(x, chr(2))[1]) tag, trim(regexp_replace(string_split(x, chr(2))[2], '\s+', ' ', 'g')) "text" FROM (SELECT page_id, unnest(l) x, generate_subscripts(l, 1) o FROM e)""")
def html_elements(spark, sf):
    return evidence.html_elements(t(spark, sf, "pages"))


@query("""SELECT event_id, 'user ' || user_id || ' ' || CASE WHEN event_type = 'error' THEN 'Api_Key' ELSE 'token' END || '=[REDACTED] from [PATH] at [LOOPBACK] and ' || CAST(event_id AS VARCHAR) || ' stays' AS shown FROM events""")
def sanitized(spark, sf):
    user = F.col("user_id").cast("string")
    name = F.when(F.col("event_type") == "error", "Api_Key : ").otherwise("token=")
    line = F.concat(F.lit("user "), user, F.lit(" "), name, F.lit("s3cr3t-"), user, F.lit(" from /home/u"), user, F.lit("/x.csv at http://localhost:80/"), user, F.lit(" and "), F.col("event_id").cast("string"), F.lit(" stays"))
    return t(spark, sf, "events").select("event_id", evidence.sanitize(line).alias("shown"))
