"""Registered queries on the star schema: scans, filters, joins, aggregates, windows, sets. Each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veridock.functions.canonical import row_text, table_digest
from veridock.operators import budgets, eventlog, lineage, segments
from veridock.sources import evidence

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _star(spark: SparkSession, sf: str) -> DataFrame:
    """Line items flattened with their order, customer, nation and region; dimensions of a fixed size are broadcast."""
    nation, region = F.broadcast(t(spark, sf, "nation")), F.broadcast(t(spark, sf, "region"))
    orders = t(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    lines = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    customer = t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))


@query("""SELECT r_name, n_name, count(*) n_lines, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(DISTINCT c_custkey) n_customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def flatten_star(spark, sf):
    return _star(spark, sf).groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n_lines"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("c_custkey").alias("n_customers"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_orderkey LIMIT 50""")
def structured_filter_topn(spark, sf):
    allowed = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}
    df = t(spark, sf, "orders")
    for column, value in allowed.items():
        df = df.where(F.col(column) == value)
    return df.orderBy("o_orderkey").limit(50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (1, 5, 17, 42, 99, 150, 199, 1000000)""")
def in_list_lookup(spark, sf):
    return t(spark, sf, "part").where(F.col("p_partkey").isin(1, 5, 17, 42, 99, 150, 199, 1000000)).select("p_partkey", "p_name", "p_brand")


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#7' THEN 0 WHEN p_type = 'PROMO' THEN 1 ELSE 2 END priority FROM part
WHERE p_brand = 'Brand#7' OR p_type = 'PROMO' OR contains(p_name, 'ring') ORDER BY 2, 1 LIMIT 40""")
def exact_priority_search(spark, sf):
    brand, kind, name = F.col("p_brand") == "Brand#7", F.col("p_type") == "PROMO", F.col("p_name").contains("ring")
    priority = F.when(brand, 0).when(kind, 1).otherwise(2)
    return t(spark, sf, "part").where(brand | kind | name).select("p_partkey", priority.alias("priority")).orderBy("priority", "p_partkey").limit(40)


@query("""SELECT p_partkey, coverage FROM (SELECT p_partkey, len(list_intersect(string_split(lower(p_name), ' '), ['red', 'ring', 'small'])) coverage, p_size FROM part) WHERE coverage >= 1 ORDER BY coverage DESC, p_size, p_partkey LIMIT 30""")
def heading_scoped_search(spark, sf):
    words = F.split(F.lower("p_name"), " ")
    coverage = F.size(F.array_intersect(words, F.array(F.lit("red"), F.lit("ring"), F.lit("small"))))
    return t(spark, sf, "part").select("p_partkey", "p_size", coverage.alias("coverage")).where("coverage >= 1").orderBy(F.desc("coverage"), "p_size", "p_partkey").limit(30).select("p_partkey", "coverage")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 100000)""")
def orphan_anti_join(spark, sf):
    return t(spark, sf, "customer").join(t(spark, sf, "orders").where("o_orderstatus = 'P' AND o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT DISTINCT n_regionkey FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier JOIN nation n2 ON s_nationkey = n2.n_nationkey WHERE n2.n_nationkey = nation.n_nationkey AND s_acctbal > 9000)""")
def uncovered_distinct(spark, sf):
    rich = t(spark, sf, "supplier").where("s_acctbal > 9000")
    return t(spark, sf, "nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_anti").select("n_regionkey").distinct()


@query("""SELECT e.event_id, e.user_id FROM events e LEFT JOIN customer c ON e.user_id = c.c_custkey AND c.c_mktsegment <> 'MACHINERY' WHERE c.c_custkey IS NULL""")
def left_join_dangling(spark, sf):
    known = t(spark, sf, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey")
    return t(spark, sf, "events").join(known, F.col("user_id") == F.col("c_custkey"), "left").where("c_custkey IS NULL").select("event_id", "user_id")


@query("""SELECT c.conv_id, c.turn, d.turn seed, length(c.text) n_chars FROM conversations c JOIN conversations d ON c.conv_id = d.conv_id AND abs(c.turn - d.turn) BETWEEN 1 AND 2 WHERE d.role = 'system'""")
def adjacent_context(spark, sf):
    from veridock.operators.search import neighbours

    conv = t(spark, sf, "conversations")
    seeds = conv.where("role = 'system'").select("conv_id", "turn")
    return neighbours(conv, "conv_id", "turn", seeds, 2).select("conv_id", "turn", "seed", F.length("text").alias("n_chars"))


@query("""SELECT o.o_orderkey, c.c_name, l.n_lines FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE c.c_mktsegment = 'BUILDING' AND o.o_totalprice > 400000""")
def inner_then_left(spark, sf):
    lines = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    c = t(spark, sf, "customer").where("c_mktsegment = 'BUILDING'")
    o = t(spark, sf, "orders").where("o_totalprice > 400000")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "c_name", "n_lines")


@query("""SELECT 'n' || n_nationkey source, 'r' || n_regionkey target, 'parent' relation FROM nation UNION SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'child' FROM nation""")
def union_bidirectional_links(spark, sf):
    n, r = F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey")
    nation = t(spark, sf, "nation")
    up = nation.select(n.alias("source"), r.alias("target"), F.lit("parent").alias("relation"))
    return up.union(nation.select(r, n, F.lit("child"))).distinct()


@query("""SELECT o_orderkey, l_linenumber, l_quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus IN ('F', 'P') AND l_quantity >= 49 ORDER BY o_orderdate, o_orderkey, l_linenumber, l_quantity LIMIT 100""")
def join_in_list_ordered(spark, sf):
    o, l = t(spark, sf, "orders").where(F.col("o_orderstatus").isin("F", "P")), t(spark, sf, "lineitem").where("l_quantity >= 49")
    return l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).orderBy("o_orderdate", "o_orderkey", "l_linenumber", "l_quantity").limit(100).select("o_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT l_orderkey, l_linenumber, p_name, s_name, n_name, r_name, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE l_quantity = 50 AND p_size = 10""")
def citation_chain(spark, sf):
    return (
        t(spark, sf, "lineitem").where("l_quantity = 50")
        .join(t(spark, sf, "part").where("p_size = 10"), F.col("l_partkey") == F.col("p_partkey"))
        .join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
        .join(F.broadcast(t(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(F.broadcast(t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select("l_orderkey", "l_linenumber", "p_name", "s_name", "n_name", "r_name", "o_orderstatus")
    )


@query("""SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NULL THEN 'EVIDENCE_NOT_FOUND' WHEN c.c_nationkey <> o.o_custkey % 25 THEN 'DOCUMENT_MISMATCH' ELSE '' END code FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 WHERE o.o_totalprice > 490000""")
def citation_mismatch_codes(spark, sf):
    c = t(spark, sf, "customer").where("c_acctbal > 0")
    code = F.when(F.col("c_custkey").isNull(), "EVIDENCE_NOT_FOUND").when(F.col("c_nationkey") != F.col("o_custkey") % 25, "DOCUMENT_MISMATCH").otherwise("")
    return t(spark, sf, "orders").where("o_totalprice > 490000").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", code.alias("code"))


@query("""WITH claims AS (SELECT o_orderkey claim_id, [o_orderpriority] issue_ids FROM orders),
cit AS (SELECT l_orderkey claim_id, l_returnflag <> 'R' resolved, [CASE WHEN l_linestatus = 'F' THEN '1-URGENT' ELSE '5-LOW' END] issues FROM lineitem WHERE l_quantity > 45)
SELECT claim_id, 'UNCITED' code FROM claims WHERE claim_id NOT IN (SELECT claim_id FROM cit)
UNION SELECT c.claim_id, CASE WHEN NOT t.resolved THEN 'UNRESOLVED' ELSE 'CROSS_ISSUE' END FROM claims c JOIN cit t USING (claim_id) WHERE NOT t.resolved OR NOT list_has_any(c.issue_ids, t.issues)""")
def claim_validation(spark, sf):
    lines = t(spark, sf, "lineitem").where("l_quantity > 45").select(
        "l_orderkey", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("citation_id"), (F.col("l_returnflag") != "R").alias("resolved"),
        F.array(F.when(F.col("l_linestatus") == "F", "1-URGENT").otherwise("5-LOW")).alias("issue_ids"),
    )
    cited = lines.groupBy("l_orderkey").agg(F.collect_set("citation_id").alias("citation_ids"))
    orders = t(spark, sf, "orders").select("o_orderkey", F.array("o_orderpriority").alias("issue_ids"))
    claims = orders.join(cited, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("claim_id"), "issue_ids", F.coalesce("citation_ids", F.array().cast("array<string>")).alias("citation_ids"))
    return lineage.validate_claims(claims, lines.select("citation_id", "issue_ids", "resolved").dropDuplicates(["citation_id"]))


@query("""WITH a AS (SELECT c_custkey id, c_mktsegment || '|' || CAST(round(c_acctbal / 500) AS INT) fp FROM customer WHERE c_custkey % 2 = 0),
b AS (SELECT c_custkey id, c_mktsegment || '|' || CAST(round(c_acctbal / 500) AS INT) fp FROM customer WHERE c_custkey % 2 = 1),
x AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY id) n, count(*) OVER (PARTITION BY fp) c FROM a), y AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY id) n, count(*) OVER (PARTITION BY fp) c FROM b)
SELECT x.id left_id, y.id right_id, CASE WHEN y.id IS NULL THEN 'MISSING' WHEN y.c > x.c THEN 'AMBIGUOUS' ELSE 'MATCHED' END code FROM x LEFT JOIN y ON x.fp = y.fp AND x.n = y.n""")
def lineage_fingerprint_match(spark, sf):
    fp = F.concat_ws("|", "c_mktsegment", F.round(F.col("c_acctbal") / 500).cast("int").cast("string"))
    c = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), fp.alias("fp"))
    return lineage.match_fingerprints(c.where("id % 2 = 0"), c.where("id % 2 = 1"), "id", "fp")


@query("""WITH m AS (SELECT c_custkey old, c_custkey - 1 AS new FROM customer WHERE c_custkey % 3 = 1), k AS (SELECT DISTINCT user_id s, CAST(json_extract(props, '$.k') AS BIGINT) d, event_type rel FROM events)
SELECT coalesce(a.new, k.s) source, coalesce(b.new, k.d) target, k.rel relation FROM k LEFT JOIN m a ON a.old = k.s LEFT JOIN m b ON b.old = k.d""")
def remapped_links(spark, sf):
    m = t(spark, sf, "customer").where("c_custkey % 3 = 1").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") - 1).alias("new"))
    k = t(spark, sf, "events").select(F.col("user_id").alias("source"), F.get_json_object("props", "$.k").cast("long").alias("target"), F.col("event_type").alias("relation")).distinct()
    return lineage.remap_links(k, m)


@query("""SELECT event_type, count(*) n, count_if(c.c_custkey IS NULL) n_missing FROM events LEFT JOIN customer c ON user_id = c_custkey AND c_custkey % 10 <> 0 GROUP BY 1""")
def link_split_report(spark, sf):
    links = t(spark, sf, "events").select(F.col("user_id").alias("source"), F.col("user_id").alias("target"), "event_type")
    known = t(spark, sf, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("id"))
    return evidence.split_links(links, known).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code").isNotNull()).alias("n_missing"))


@query("""SELECT p_partkey, list_sort(list(s_suppkey ORDER BY s_suppkey))[1:5] suppliers FROM (SELECT DISTINCT p_partkey, s_suppkey, row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) n FROM (SELECT DISTINCT p_partkey, s_suppkey FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE contains(p_name, 'widget') AND s_acctbal > 0)) WHERE n <= 5 GROUP BY 1""")
def targets_at_most_five(spark, sf):
    pairs = t(spark, sf, "part").where(F.col("p_name").contains("widget")).join(t(spark, sf, "lineitem"), F.col("l_partkey") == F.col("p_partkey"))
    pairs = pairs.join(t(spark, sf, "supplier").where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("p_partkey", "s_suppkey").distinct()
    top = budgets.top_per_group(pairs, ["p_partkey"], ["s_suppkey"], 5)
    return top.groupBy("p_partkey").agg(F.array_sort(F.collect_list("s_suppkey")).alias("suppliers"))


@query("""WITH l AS (SELECT event_id id, event_type code, CAST(user_id % 50 AS VARCHAR) message FROM events WHERE event_id % 3 <> 0), r AS (SELECT event_id + CASE WHEN event_id % 5 = 0 THEN 10000000 ELSE 0 END id, event_type code, CAST(user_id % 50 AS VARCHAR) message FROM events WHERE event_id % 7 <> 0),
g AS (SELECT *, row_number() OVER (PARTITION BY code, message ORDER BY id) n FROM l WHERE id NOT IN (SELECT id FROM r)), a AS (SELECT *, row_number() OVER (PARTITION BY code, message ORDER BY id) n FROM r WHERE id NOT IN (SELECT id FROM l))
SELECT g.id left_id, a.id right_id, CASE WHEN a.id IS NULL THEN 'WARNING_REMOVED' WHEN g.id IS NULL THEN 'WARNING_ADDED' ELSE 'WARNING_CHANGED' END kind FROM g FULL JOIN a ON g.code = a.code AND g.message = a.message AND g.n = a.n""")
def warning_differences(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.col("event_type").alias("code"), (F.col("user_id") % 50).cast("string").alias("message"))
    left = e.where("event_id % 3 <> 0").withColumnRenamed("event_id", "id")
    right = e.where("event_id % 7 <> 0").select((F.col("event_id") + F.when(F.col("event_id") % 5 == 0, 10000000).otherwise(0)).alias("id"), "code", "message")
    return lineage.warning_differences(left, right)


@query("""SELECT user_id, k, n, best FROM (SELECT user_id, k, n, rank() OVER (PARTITION BY user_id ORDER BY n DESC) best, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, k) rn FROM (SELECT user_id, CAST(json_extract(props, '$.k') AS INT) k, count(*) n FROM events GROUP BY 1, 2)) WHERE best = 1 AND rn <= 5""")
def best_score_at_most_five(spark, sf):
    n = t(spark, sf, "events").groupBy("user_id", F.get_json_object("props", "$.k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("user_id")
    ranked = n.withColumns({"best": F.rank().over(w.orderBy(F.desc("n"))), "rn": F.row_number().over(w.orderBy(F.desc("n"), "k"))})
    return ranked.where("best = 1 AND rn <= 5").select("user_id", "k", "n", "best")


@query("""SELECT c_custkey, coalesce(n, 0) n_claims, coalesce(rejected, 0) n_rejected, CASE WHEN coalesce(n, 0) = 0 THEN 'UNSUPPORTED' WHEN rejected > 0 THEN 'PARTIAL' ELSE 'SUPPORTED' END status FROM customer LEFT JOIN (SELECT o_custkey, count(*) n, count_if(o_orderstatus = 'P') rejected FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def reconcile_issue_results(spark, sf):
    counts = t(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("rejected"))
    n, r = F.coalesce("n", F.lit(0)), F.coalesce("rejected", F.lit(0))
    status = F.when(n == 0, "UNSUPPORTED").when(r > 0, "PARTIAL").otherwise("SUPPORTED")
    return t(spark, sf, "customer").join(counts, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", n.alias("n_claims"), r.alias("n_rejected"), status.alias("status"))


@query("""SELECT o_orderkey, list_sort(list(DISTINCT l_returnflag || ':' || l_linestatus)) lineage FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""")
def collected_lineage(spark, sf):
    pairs = t(spark, sf, "lineitem").join(t(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.groupBy("o_orderkey").agg(F.array_sort(F.collect_set(F.concat_ws(":", "l_returnflag", "l_linestatus"))).alias("lineage"))


@query("""SELECT 'region' entity, count(*) n FROM region UNION ALL SELECT 'nation', count(*) FROM nation UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages""")
def row_counts(spark, sf):
    names = ["region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages"]
    parts = [t(spark, sf, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("entity"), "n") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("""SELECT count(*) n_rows, CAST(sum(CAST('0x' || h[1:12] AS HUGEINT)) AS VARCHAR) digest_a, CAST(sum(CAST('0x' || h[13:24] AS HUGEINT)) AS VARCHAR) digest_b FROM (SELECT sha256(CAST(c_custkey AS VARCHAR) || chr(31) || c_name || chr(31) || CAST(c_nationkey AS VARCHAR) || chr(31) || c_mktsegment) h FROM customer)""")
def snapshot_digest(spark, sf):
    c = t(spark, sf, "customer")
    return table_digest(c, row_text(c, "c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@query("""SELECT count(*) only_left, 0 only_right FROM (SELECT o_orderkey, o_orderstatus FROM orders EXCEPT ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 11 <> 0)""")
def set_equality_check(spark, sf):
    o = t(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return lineage.set_equal(o, o.where("o_orderkey % 11 <> 0")).select("only_left", F.col("only_right").cast("int").alias("only_right"))


@query("""SELECT l_returnflag, l_linestatus, count(*) n, count(DISTINCT l_quantity) n_values, count(DISTINCT l_quantity) > 1 AS conflict FROM lineitem GROUP BY 1, 2""")
def conflict_groups(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("l_quantity").alias("n_values"), (F.count_distinct("l_quantity") > 1).alias("conflict"))


@query("""SELECT sha256(text) source_hash, min(doc_id) id, count(*) n, count(DISTINCT source) > 1 conflict FROM documents GROUP BY 1""")
def dedup_source_hash(spark, sf):
    src = t(spark, sf, "documents").select(F.sha2("text", 256).alias("source_hash"), F.col("doc_id").alias("id"), F.col("source").alias("parser"))
    return evidence.dedupe_sources(src).select("source_hash", "id", "n", "conflict")


@query("""SELECT code, count(*) n FROM (SELECT unnest([CASE WHEN value < 1 THEN 'VALUE_TOO_SMALL' END, CASE WHEN event_type = 'error' THEN 'ERROR_TYPE' END, CASE WHEN user_id % 10 = 0 THEN 'ROUND_USER' END, CASE WHEN CAST(json_extract(props, '$.k') AS INT) > 90 THEN 'LARGE_KEY' END]) code FROM events) WHERE code IS NOT NULL GROUP BY 1""")
def row_lint(spark, sf):
    checks: dict[str, Column] = {
        "VALUE_TOO_SMALL": F.col("value") < 1,
        "ERROR_TYPE": F.col("event_type") == "error",
        "ROUND_USER": F.col("user_id") % 10 == 0,
        "LARGE_KEY": F.get_json_object("props", "$.k").cast("int") > 90,
    }
    return evidence.lint(t(spark, sf, "events"), checks)


@query("""WITH o AS (SELECT c_custkey id, c_nationkey h, 'reviewed ' || c_name txt, CASE WHEN c_custkey % 4 = 0 THEN 'AUTOMATIC' ELSE 'APPROVED' END st FROM customer), n AS (SELECT c_custkey id, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE c_nationkey END h, c_name txt FROM customer)
SELECT n.id stable_id, CASE WHEN n.h = o.h AND o.st <> 'AUTOMATIC' THEN o.txt ELSE n.txt END text, CASE WHEN n.h = o.h AND o.st <> 'AUTOMATIC' THEN o.st ELSE 'AUTOMATIC' END review_status, o.st <> 'AUTOMATIC' AND n.h <> o.h unresolved FROM n JOIN o ON n.id = o.id""")
def keep_reviewed_text(spark, sf):
    c = t(spark, sf, "customer")
    old = c.select(F.col("c_custkey").alias("stable_id"), F.col("c_nationkey").alias("source_hash"), F.concat(F.lit("reviewed "), "c_name").alias("text"), F.when(F.col("c_custkey") % 4 == 0, "AUTOMATIC").otherwise("APPROVED").alias("review_status"))
    new = c.select(F.col("c_custkey").alias("stable_id"), F.when(F.col("c_custkey") % 5 == 0, -1).otherwise(F.col("c_nationkey")).alias("source_hash"), F.col("c_name").alias("text"))
    return lineage.keep_reviewed(old, new)


@query("""SELECT user_id, min(ts)::DATE::VARCHAR first_seen, max(ts)::DATE::VARCHAR last_seen, count(*) sightings FROM events GROUP BY 1""")
def upsert_queue(spark, sf):
    e = t(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("seen"), "event_id")
    previous = e.where("event_id % 2 = 0").groupBy("user_id").agg(F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.count(F.lit(1)).alias("sightings"))
    return lineage.upsert(previous, e.where("event_id % 2 = 1"), "user_id")


@query("""SELECT l_suppkey, l_returnflag, round(min(l_extendedprice), 2) lo, round(max(l_extendedprice), 2) hi, min(l_quantity) q_lo, max(l_quantity) q_hi, max(CASE l_linestatus WHEN 'F' THEN 1 ELSE 0 END) worst, count(DISTINCT l_partkey) n_parts FROM lineitem GROUP BY 1, 2""")
def semantic_groups_bbox(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(
        F.round(F.min("l_extendedprice"), 2).alias("lo"), F.round(F.max("l_extendedprice"), 2).alias("hi"), F.min("l_quantity").alias("q_lo"), F.max("l_quantity").alias("q_hi"),
        F.max(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("worst"), F.count_distinct("l_partkey").alias("n_parts"),
    )


@query("""SELECT c_custkey source, lead(c_custkey) OVER w target, 'next_sibling' relation FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey) QUALIFY lead(c_custkey) OVER w IS NOT NULL
UNION ALL SELECT c_custkey, lag(c_custkey) OVER w, 'previous_sibling' FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey) QUALIFY lag(c_custkey) OVER w IS NOT NULL""")
def sibling_links(spark, sf):
    return segments.siblings(t(spark, sf, "customer"), ["c_nationkey"], "c_custkey", "c_custkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) ordinal FROM lineitem""")
def page_local_ordinal(spark, sf):
    lines = t(spark, sf, "lineitem")
    return segments.ordinal(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "ordinal")


@query("""SELECT p_partkey, lower(replace(p_name, ' ', '-')) || CASE WHEN n > 0 THEN '-' || n ELSE '' END anchor FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) - 1 n FROM part)""")
def heading_anchors(spark, sf):
    return segments.heading_anchors(t(spark, sf, "part"), ["p_brand"], "p_partkey", "p_name").select("p_partkey", "anchor")


@query("""SELECT conv_id, turn, row_number() OVER w place, turn + 1 <> row_number() OVER w gap, lag(role) OVER w previous FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def sequence_gap_check(spark, sf):
    conv = t(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    place = F.row_number().over(w)
    return conv.select("conv_id", "turn", place.alias("place"), (F.col("turn") + 1 != place).alias("gap"), F.lag("role").over(w).alias("previous"))


@query("""SELECT user_id, max_by(event_type, event_id) event_type, max_by(value, event_id) AS value, max(event_id) event_id, count(*) n_events FROM events GROUP BY 1""")
def state_projection(spark, sf):
    return eventlog.current_state(t(spark, sf, "events"), "user_id", "event_id", "event_type", "value")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) n FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00') WHERE n = 1""")
def latest_as_of(spark, sf):
    cutoff = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return eventlog.latest_as_of(t(spark, sf, "events"), "user_id", "ts", "event_id", cutoff, "event_type").select("user_id", "event_id", "event_type")


@query("""SELECT user_id, count(*) n_attempts, count_if(p = 'error') n_retries FROM (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) p FROM events) GROUP BY 1""")
def event_retry_count(spark, sf):
    return eventlog.retries(t(spark, sf, "events"), ["user_id"], ["event_id"], "event_type", "error")


@query("""SELECT event_type, CAST(sum(CASE WHEN user_id % 2 = 0 THEN event_id ELSE 0 END) AS BIGINT) work_ms, CAST(sum(CASE WHEN user_id % 2 = 1 THEN event_id ELSE 0 END) AS BIGINT) external_ms, sum(CASE WHEN user_id % 2 = 0 THEN event_id ELSE 0 END) <= 5000000 within_budget FROM events GROUP BY 1""")
def stage_totals(spark, sf):
    return eventlog.run_metrics(t(spark, sf, "events"), "event_type", "event_id", F.col("user_id") % 2 == 1, 5000000)


@query("""SELECT user_id, event_type, count(DISTINCT props) n_payloads, count(*) n_events FROM events GROUP BY 1, 2 HAVING count(DISTINCT props) > 1""")
def append_conflicts(spark, sf):
    return eventlog.append_conflicts(t(spark, sf, "events"), ["user_id", "event_type"], "props")


@query("""WITH e AS (SELECT user_id, event_id, ['RECEIVED','CLASSIFYING_INPUTS','READY_TO_EVALUATE','RETRIEVING_EVIDENCE','RUNNING_MATH','BLOCKED','FAILED'][1 + (event_id // 7 + user_id) % 7] s FROM events), p AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY event_id) q FROM e)
SELECT user_id, event_id, CASE WHEN q IS NULL THEN CASE WHEN s <> 'RECEIVED' THEN 'INITIAL_MUST_ENTER_RECEIVED' END WHEN q = 'FAILED' THEN 'TERMINAL_STATE' WHEN q = 'BLOCKED' THEN 'RESUME_REQUIRED'
WHEN (q = 'RECEIVED' AND s IN ('CLASSIFYING_INPUTS','FAILED')) OR (q = 'CLASSIFYING_INPUTS' AND s IN ('READY_TO_EVALUATE','BLOCKED','FAILED')) OR (q = 'READY_TO_EVALUATE' AND s IN ('RETRIEVING_EVIDENCE','BLOCKED','FAILED')) OR (q = 'RETRIEVING_EVIDENCE' AND s IN ('RUNNING_MATH','BLOCKED','FAILED')) OR (q = 'RUNNING_MATH' AND s IN ('BLOCKED','FAILED')) THEN NULL ELSE 'TRANSITION_NOT_ALLOWED' END error FROM p""")
def transition_check(spark, sf):
    names = ["RECEIVED", "CLASSIFYING_INPUTS", "READY_TO_EVALUATE", "RETRIEVING_EVIDENCE", "RUNNING_MATH", "BLOCKED", "FAILED"]
    state = F.element_at(F.array(*[F.lit(n) for n in names]), (1 + (F.expr("event_id div 7") + F.col("user_id")) % 7).cast("int"))
    events = t(spark, sf, "events").select("user_id", "event_id", state.alias("state"))
    return eventlog.check_sequence(events, "user_id", "event_id", "state", F.lit("TRANSITION")).select("user_id", "event_id", "error")


@query("""SELECT event_id, k path, CASE WHEN event_id % 2 = 0 THEN 'CHANGED' ELSE 'REMOVED' END kind FROM (SELECT event_id, 'k' k FROM events)""")
def json_diff(spark, sf):
    e = t(spark, sf, "events")
    left = lineage.json_entries(e, "event_id", "props")
    right = lineage.json_entries(e.where("event_id % 2 = 0").select("event_id", F.lit('{"k": -1}').alias("props")), "event_id", "props")
    return lineage.structural_diff(left, right, ["event_id", "path"], "value").select("event_id", "path", "kind")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'RECHECK_REQUIRED' WHEN s_acctbal < 0 THEN 'STALE' ELSE 'UNCHANGED' END status FROM supplier""")
def source_change_impact(spark, sf):
    from veridock.operators.graph import impact

    s = t(spark, sf, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey")
    after = s.where("s_suppkey % 10 <> 9").withColumn("s_acctbal", F.when(F.col("s_acctbal") < 0, 0.0).otherwise(F.col("s_acctbal")))
    return impact(s, after, "s_suppkey", "s_acctbal", "s_nationkey")


@query("""SELECT year(o_orderdate) y, o_orderpriority p, count(*) n, round(sum(o_totalprice), 2) total FROM orders GROUP BY ROLLUP (year(o_orderdate), o_orderpriority)""")
def rollup_totals(spark, sf):
    return t(spark, sf, "orders").rollup(F.year("o_orderdate").cast("long").alias("y"), F.col("o_orderpriority").alias("p")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""SELECT date_trunc('hour', ts)::VARCHAR AS hour, event_type, count(*) n, round(sum(value), 2) total FROM events GROUP BY 1, 2""")
def tumbling_windows(spark, sf):
    return t(spark, sf, "events").groupBy(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("""SELECT user_id, session, count(*) n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)) GROUP BY 1, 2""")
def sessions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("p").isNull() | (F.col("ts") > F.col("p") + F.expr("INTERVAL 6 HOURS"))
    marked = t(spark, sf, "events").withColumn("p", F.lag("ts").over(w)).withColumn("session", F.sum(gap.cast("int")).over(w))
    return marked.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))

