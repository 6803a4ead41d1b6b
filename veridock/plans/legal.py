"""Registered queries of clauses, references, structure diffs, graphs, migrations and ingest. Each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from veridock.functions.canonical import row_text
from veridock.operators import claims, clauses, drawings, facets, governance, graph, lineage, matters, migration, packets, ranks, references, relevance
from veridock.plans.relational import t
from veridock.sources import ingest

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return keep


#: Thirteen kinds of lines; {n} is a number from 1 to 3.
FORMS = ("부록", "제{n}조", "제{n}조(가) 글", "제{n}조 ① 하나 ② 둘", "① 항", "글 ② 항 ③ 항", "{n}-1. 기준", "{n}-2. ① 표", "가. 글", "{n}) 수", "다) 잎", "글", "더")


def _lines(spark, sf):
    """Order lines as lines of a text: an order is a revision."""
    n = (F.col("l_linenumber") % 3 + 1).cast("string")
    form = (F.col("l_orderkey") * 7 + F.col("l_linenumber") * F.col("l_partkey")) % len(FORMS)
    texts = F.array(*[F.lit(f) for f in FORMS])
    text = F.replace(F.element_at(texts, (form + 1).cast("int")), F.lit("{n}"), n)
    # Line numbers repeat within an order, and some lines repeat as a whole.
    place = F.col("l_linenumber") * 10_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("revision"), place.alias("pos"), place.cast("string").alias("element"), text.alias("text"))
    return clauses.by_revision(lines).distinct()


CLAUSES = """WITH l AS (SELECT DISTINCT l_orderkey r, CAST(l_linenumber AS BIGINT) * 10000000000000 + l_partkey * 1000000 + l_suppkey p, CAST(l_linenumber % 3 + 1 AS VARCHAR) n, (l_orderkey * 7 + l_linenumber * l_partkey) % 13 f FROM lineitem),
a AS (SELECT *, CASE WHEN f = 0 THEN 'x' WHEN f IN (1, 2, 3) THEN 'a' WHEN f = 6 THEN 's' END sure FROM l),
b AS (SELECT *, last_value(sure IGNORE NULLS) OVER w base FROM a WINDOW w AS (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, CASE WHEN sure IS NOT NULL THEN sure WHEN f = 7 AND coalesce(base, '') <> 'a' THEN 's' END opens FROM b),
e AS (SELECT *, count(opens) OVER w region, last_value(opens IGNORE NULLS) OVER w kind, last_value(CASE WHEN opens IS NOT NULL THEN n END IGNORE NULLS) OVER w rn, last_value(CASE WHEN opens IS NOT NULL THEN f END IGNORE NULLS) OVER w rf FROM c WINDOW w AS (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING)),
g AS (SELECT *, row_number() OVER w nth, coalesce(count(CASE WHEN f = 8 THEN 1 END) OVER w, 0) letters FROM e WINDOW w AS (PARTITION BY r, region ORDER BY p ROWS UNBOUNDED PRECEDING)),
h AS (SELECT *, last_value(CASE WHEN f = 9 AND opens IS NULL THEN n END IGNORE NULLS) OVER (PARTITION BY r, region, letters ORDER BY p ROWS UNBOUNDED PRECEDING) num FROM g),
s AS (SELECT *, CASE WHEN rf = 6 THEN rn || '-1' ELSE rn || '-2' END std, CASE WHEN letters > 0 THEN '/가' ELSE '' END lt, '제' || rn || '조' art FROM h),
k AS (SELECT *, CASE WHEN opens = 'x' THEN [('APPENDIX', '부록')] WHEN f = 1 THEN [] WHEN f = 2 THEN [(art, '글')] WHEN f = 3 THEN [(art || '#1', '① 하나'), (art || '#2', '② 둘')]
 WHEN kind = 'a' AND f = 4 THEN [(art || '#1', '① 항')] WHEN kind = 'a' AND f = 5 THEN [(art || '#2', '② 항'), (art || '#3', '③ 항')] WHEN kind = 'a' AND f = 7 THEN [(art || '#1', '① 표')]
 WHEN opens = 's' THEN [(std, CASE f WHEN 6 THEN '기준' ELSE '① 표' END)] WHEN kind = 's' AND f = 8 THEN [(std || lt, '글')] WHEN kind = 's' AND f = 9 THEN [(std || lt || '/' || num, '수')]
 WHEN kind = 's' AND f = 10 THEN [(std || lt || coalesce('/' || num, '') || '/다', '잎')] WHEN kind = 'a' AND rf = 1 AND nth = 2 THEN [(art, NULL)] ELSE [] END ks,
 ['부록', '', '', '', '① 항', '글 ② 항 ③ 항', '', n || '-2. ① 표', '가. 글', n || ') 수', '다) 잎', '글', '더'][f + 1] raw FROM s),
x AS (SELECT r, p, i, opens, raw, CASE WHEN len(ks) > 0 THEN ks[i] END kk FROM k, range(1, 3) y(i) WHERE i <= greatest(len(ks), 1)),
o AS (SELECT *, count(kk) OVER (PARTITION BY r ORDER BY p, i ROWS UNBOUNDED PRECEDING) ord FROM x)
SELECT r revision, CAST(ord AS BIGINT) ord, max(kk[1]) "key", string_agg(coalesce(kk[2], raw), ' ' ORDER BY p, i) "text", CAST(count(DISTINCT p) AS INT) n_sources FROM o WHERE ord > 0 AND (kk IS NOT NULL OR opens IS NULL) GROUP BY 1, 2"""


@query(CLAUSES)
def clause_hierarchy(spark, sf):
    """Clauses of every order's lines, with their place in the hierarchy."""
    made = clauses.derive_clauses(_lines(spark, sf))
    return made.select("revision", F.col("ord").cast("long").alias("ord"), "key", "text", F.size("sources").alias("n_sources"))


@query("""WITH rf AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN lower(n_name) || '  ACT' WHEN 1 THEN n_name WHEN 2 THEN 'zzz ' || (o_orderkey % 7) ELSE n_name || ' act' END title, '제' || (o_orderkey % 5 + 1) || '조' art, CASE WHEN o_orderkey % 3 = 0 THEN '제' || (o_orderkey % 2 + 1) || '항' END par
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
c AS (SELECT *, regexp_replace(title, '\\s+', ' ', 'g') said, regexp_replace(lower(title), '[^0-9a-z]', '', 'g') w FROM rf), d AS (SELECT n_nationkey doc, regexp_replace(lower(n_name || ' act'), '[^0-9a-z]', '', 'g') k FROM nation),
m AS (SELECT w, CASE WHEN count_if(w = k) = 1 THEN min(CASE WHEN w = k THEN doc END) WHEN count_if(contains(k, w) OR contains(w, k)) = 1 THEN min(CASE WHEN contains(k, w) OR contains(w, k) THEN doc END) END doc FROM (SELECT DISTINCT w FROM c), d GROUP BY 1),
pl AS (SELECT s_nationkey doc, s_suppkey ev, '제' || (s_suppkey % 4 + 1) || '조' anchor, CASE WHEN s_suppkey % 3 = 0 THEN '제1항' END inner_par FROM supplier),
h AS (SELECT DISTINCT c.said, c.art, c.par, m.doc, pl.ev FROM c JOIN m USING (w) JOIN pl ON pl.doc = m.doc AND pl.anchor = c.art WHERE c.par IS NULL OR c.par = pl.inner_par),
f AS (SELECT *, row_number() OVER (PARTITION BY said, art, par ORDER BY ev) rn FROM h QUALIFY rn <= 5)
SELECT o_orderkey, CASE WHEN m.doc IS NULL THEN 'source_not_ingested' WHEN f.ev IS NULL THEN 'reference_target_missing' ELSE 'rule_source' END relation,
CASE WHEN m.doc IS NULL THEN 'MISSING-SOURCE-' || upper(sha256(c.said || '|' || c.art || '|' || coalesce(c.par, '') || '|')[1:24]) WHEN f.ev IS NULL THEN 'MISSING-REFERENCE-' || upper(sha256(m.doc || chr(31) || c.said || '|' || c.art || '|' || coalesce(c.par, '') || '|')[1:24]) ELSE CAST(f.ev AS VARCHAR) END target
FROM c JOIN m USING (w) LEFT JOIN f ON f.said = c.said AND f.art = c.art AND f.par IS NOT DISTINCT FROM c.par""")
def written_references(spark, sf):
    """References written in every order, to acts of nations and places in them."""
    k = F.col("o_orderkey")
    name = F.element_at(F.array(F.concat(F.lower("n_name"), F.lit("  ACT")), F.col("n_name"), F.concat(F.lit("zzz "), (k % 7).cast("string")), F.concat("n_name", F.lit(" act"))), (k % 4 + 1).cast("int"))
    paragraph = F.when(k % 3 == 0, F.concat(F.lit(" 제"), (k % 2 + 1).cast("string"), F.lit("항"))).otherwise("")
    text = F.concat(F.lit("see 「"), name, F.lit("」 제"), (k % 5 + 1).cast("string"), F.lit("조"), paragraph, F.lit(" there"))
    orders = t(spark, sf, "orders").join(t(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(t(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    refs = references.extract_references(orders.select("o_orderkey", text.alias("text")), "o_orderkey", "text")
    documents = t(spark, sf, "nation").select(F.col("n_nationkey").alias("document"), F.concat("n_name", F.lit(" act")).alias("title"))
    s = F.col("s_suppkey")
    places = t(spark, sf, "supplier").select(F.col("s_nationkey").alias("document"), s.alias("evidence"), F.concat(F.lit("[제"), (s % 4 + 1).cast("string"), F.lit("조(x)")).alias("title"), F.when(s % 3 == 0, "한 제1항").otherwise("").alias("text"))
    return references.reference_links(refs, documents, places, "o_orderkey").select("o_orderkey", "relation", "target")


def _dependencies(spark, sf):
    """Regions, nations, customers, orders, each needing the one before; in some nations every hundredth customer is needed by its nation."""
    n, c, o = t(spark, sf, "nation"), t(spark, sf, "customer"), t(spark, sf, "orders")

    def edge(df, a, x, b, y):
        return df.select(F.concat(F.lit(a), F.col(x).cast("string")).alias("source"), F.concat(F.lit(b), F.col(y).cast("string")).alias("target"))

    edges = edge(n, "r", "n_regionkey", "n", "n_nationkey").union(edge(c, "n", "c_nationkey", "c", "c_custkey")).union(edge(o, "c", "o_custkey", "o", "o_orderkey"))
    edges = edges.union(edge(c.where("c_custkey % 100 = 0 AND c_nationkey % 5 = 0"), "c", "c_custkey", "n", "c_nationkey"))
    nodes = edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct()
    return edges, nodes


STUCK = "st AS (SELECT c_nationkey k, min('c' || c_custkey) low FROM customer WHERE c_custkey % 100 = 0 AND c_nationkey % 5 = 0 GROUP BY 1)"


@query(f"""WITH {STUCK}, cu AS (SELECT c_custkey, c_nationkey IN (SELECT k FROM st) x FROM customer)
SELECT DISTINCT 'r' || n_regionkey node, 1 AS level FROM nation UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey IN (SELECT k FROM st) THEN NULL ELSE 2 END FROM nation
UNION ALL SELECT 'c' || c_custkey, CASE WHEN x THEN NULL ELSE 3 END FROM cu UNION ALL SELECT 'o' || o_orderkey, CASE WHEN x THEN NULL ELSE 4 END FROM orders JOIN cu ON c_custkey = o_custkey""")
def dependency_levels(spark, sf):
    """In which round every node of a dependency graph is free; none for what hangs on a cycle."""
    return graph.peel(*_dependencies(spark, sf))


@query(f"""WITH {STUCK} SELECT 'n' || k node, low "cycle" FROM st UNION ALL SELECT 'c' || c_custkey, low FROM customer JOIN st ON k = c_nationkey WHERE c_custkey % 100 = 0""")
def dependency_cycles(spark, sf):
    return graph.cycles(*_dependencies(spark, sf))


LEVELS = ", ".join(f"""l{k + 1} AS (SELECT g i, CASE WHEN max(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END h FROM (SELECT i, h, CASE WHEN c = 1 THEN i ELSE i // 64 END g, c FROM (SELECT *, count(*) OVER () c FROM l{k})) GROUP BY 1)""" for k in range(5))


@query(f"""WITH l0 AS (SELECT row_number() OVER (ORDER BY o_orderkey, h) - 1 i, h FROM (SELECT o_orderkey, sha256(o_orderkey || chr(31) || o_custkey || chr(31) || o_orderstatus) h FROM orders)), {LEVELS}
SELECT (SELECT count(*) FROM orders) n_rows, h digest FROM l5""")
def ordered_snapshot_digest(spark, sf):
    """One digest of all orders in order of their keys, as a tree."""
    o = t(spark, sf, "orders")
    return ranks.ordered_digest(o.select("o_orderkey", "o_custkey", "o_orderstatus"), ["o_orderkey"], row_text(o, "o_orderkey", "o_custkey", "o_orderstatus"))


@query("""WITH e AS (SELECT event_id, user_id u, event_id % 6 f FROM events)
SELECT event_id, '$.a.b' path, 'CHANGED' kind, '' || u left_value, '' || (u + 1) right_value FROM e WHERE f = 1
UNION ALL SELECT event_id, '$.a.list[1].z', 'REMOVED', 'true', NULL FROM e WHERE f = 2 UNION ALL SELECT event_id, '$.t', 'TYPE_CHANGED', '"x"', '1' FROM e WHERE f = 3
UNION ALL SELECT event_id, '$["odd name"]', 'ADDED', NULL, 'null' FROM e WHERE f = 4
UNION ALL SELECT event_id, '$.a.list', 'ADDED', NULL, '[]' FROM e WHERE f = 5 UNION ALL SELECT event_id, '$.a.list[0]', 'REMOVED', '1', NULL FROM e WHERE f = 5 UNION ALL SELECT event_id, '$.a.list[1].z', 'REMOVED', 'true', NULL FROM e WHERE f = 5""")
def nested_json_diff(spark, sf):
    """Nested payloads of all events against changed ones."""
    e = t(spark, sf, "events")
    u, f = F.col("user_id"), F.col("event_id") % 6

    def payload(b, items, name, more):
        return F.concat(F.lit('{"a": {"b": '), b.cast("string"), F.lit(', "list": ['), items, F.lit(']}, "t": '), name, more, F.lit("}"))

    whole, none = F.lit('1, {"z": true}'), F.lit("")
    items = F.when(f == 2, F.lit("1")).when(f == 5, none).otherwise(whole)
    left = e.select("event_id", payload(u, whole, F.lit('"x"'), none).alias("j"))
    right = e.select("event_id", payload(F.when(f == 1, u + 1).otherwise(u), items, F.when(f == 3, "1").otherwise('"x"'), F.when(f == 4, ', "odd name": null').otherwise("")).alias("j"))
    return lineage.json_differences(left, right, "event_id", "j")


GROUPS, ANCHORS, INTENTS = (("edst", "thor"),), ((("the", "of"), (("anth",), ("est", "ing"))),), ((("er",), (("erat",), ("ous",))),)


@query("""WITH n AS (SELECT count(*) n FROM benchmark), q AS (SELECT item_id, lower(text) u FROM benchmark), p AS (SELECT item_id, doc_id, u, lower(coalesce(source, '') || ' ' || coalesce(text, '')) c FROM documents, n JOIN q ON item_id = doc_id % n.n)
SELECT item_id q, doc_id "key", CASE WHEN ((contains(u, 'edst') OR contains(u, 'thor')) AND (contains(c, 'edst') OR contains(c, 'thor')) AND NOT (contains(u, 'edst') AND contains(c, 'edst') OR contains(u, 'thor') AND contains(c, 'thor'))) THEN 'REJECT_SUBJECT_CONFLICT'
WHEN contains(u, 'the') AND contains(u, 'of') AND NOT (contains(c, 'anth') OR contains(c, 'est') AND contains(c, 'ing')) THEN 'REJECT_REQUIRED_ANCHOR_MISSING'
WHEN contains(u, 'er') AND NOT (contains(c, 'erat') OR contains(c, 'ous')) THEN 'RETRIEVAL_RELEVANCE_INSUFFICIENT'
WHEN contains(u, 'edst') AND contains(c, 'edst') OR contains(u, 'thor') AND contains(c, 'thor') THEN 'ACCEPT_SUBJECT_MATCH' ELSE 'ACCEPT_NO_DETERMINISTIC_CONFLICT' END code FROM p""")
def clause_relevance(spark, sf):
    """Every document judged against one benchmark item."""
    items, docs = t(spark, sf, "benchmark"), t(spark, sf, "documents")
    pairs = docs.crossJoin(F.broadcast(items.agg(F.count(F.lit(1)).alias("n")))).select((F.col("doc_id") % F.col("n")).alias("q"), F.col("doc_id").alias("key"))
    queries = items.select(F.col("item_id").alias("q"), F.lit("").alias("question"), "text")
    found = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("title"), "text")
    judged = relevance.judge(pairs, queries, found, GROUPS, ANCHORS, INTENTS)
    return judged.select("q", "key", F.col("codes")[0].alias("code"))


@query("""WITH e AS (SELECT 'm' || o_custkey matter, o_orderkey k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) s, o_orderkey % 5 f, 'i' || (o_orderkey // 5 % 4) i FROM orders),
a AS (SELECT *, CASE f WHEN 0 THEN true WHEN 1 THEN s = min(CASE WHEN f = 1 THEN s END) OVER (PARTITION BY matter, i) WHEN 2 THEN coalesce(min(CASE WHEN f = 1 THEN s END) OVER (PARTITION BY matter, i) < s, false) WHEN 3 THEN false ELSE NULL END ok FROM e),
b AS (SELECT *, count_if(ok) OVER (PARTITION BY matter ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) rev FROM (SELECT * FROM a WHERE f <> 4))
SELECT matter, count(*) n_events, CAST(count_if(ok) AS BIGINT) revision, count_if(f = 3) mismatched, CAST(count(DISTINCT CASE WHEN f = 1 AND ok THEN i END) AS INT) n_issues, coalesce('t' || max_by(k, s) FILTER (WHERE f = 0), '') title FROM a WHERE f <> 4 GROUP BY 1""")
def matter_projection(spark, sf):
    """Orders as events of their customers' matters, folded: titles, issues that are added once, states of issues that exist, events that expect another revision."""
    k, f = F.col("o_orderkey"), F.col("o_orderkey") % 5
    e = t(spark, sf, "orders").where(f != 4).withColumn("sequence", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    issue = F.concat(F.lit("i"), (F.floor(k / 5) % 4).cast("string"))
    payload = (
        F.when(f == 0, F.to_json(F.struct(F.concat(F.lit("t"), k.cast("string")).alias("title"))))
        .when(f == 1, F.to_json(F.struct(issue.alias("issue_id"), F.lit("?").alias("question"), F.lit("OPEN").alias("work_state"), F.array().cast("array<string>").alias("depends_on"))))
        .otherwise(F.to_json(F.struct(issue.alias("issue_id"), F.lit("DONE").alias("work_state"))))
    )
    kind = F.element_at(F.array(*map(F.lit, ("TITLE_CHANGED", "ISSUE_ADDED", "ISSUE_STATE_CHANGED", "TITLE_CHANGED"))), (f + 1).cast("int"))
    events = e.select(F.concat(F.lit("m"), F.col("o_custkey").cast("string")).alias("matter"), "sequence", F.when(f == 3, F.lit(-1)).cast("long").alias("expected"), kind.alias("kind"), payload.alias("payload"))
    verdicts = matters.fold(events)
    last = F.max("state")
    state = "title string, revision long, issues map<string, struct<work_state:string>>"
    folded = verdicts.groupBy("matter").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("code") == "REVISION_MISMATCH").alias("mismatched"), F.from_json(last, state).alias("s"))
    return folded.select("matter", "n_events", "s.revision", "mismatched", F.size("s.issues").alias("n_issues"), "s.title")


@query("""WITH c AS (SELECT c_custkey k, c_custkey // 2 base, CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END st, c_custkey % 5 <> 0 kept, c_custkey % 7 = 0 flipped FROM customer),
b AS (SELECT base, count(*) n, min(k) k FROM c WHERE kept GROUP BY 1)
SELECT 'L' || c.k id, CASE WHEN kept AND NOT flipped THEN 'MATCHED' WHEN n > 1 THEN 'AMBIGUOUS' WHEN n = 1 THEN 'REVIEWED_VALUE_CONFLICT' ELSE 'MISSING' END code,
CASE WHEN kept AND NOT flipped THEN 'R' || c.k WHEN n = 1 THEN 'R' || b.k END target, (SELECT count(*) FROM orders WHERE o_custkey = c.k) n_links FROM c LEFT JOIN b USING (base)""")
def lineage_migration(spark, sf):
    """Old clauses of customers matched with new ones, some of which went or were reviewed; links of orders rewritten."""
    c = F.col("c_custkey")
    base = F.floor(c / 2).alias("base")
    status = F.when(c % 2 == 0, "A").otherwise("B")
    old = t(spark, sf, "customer").select(F.concat(F.lit("L"), c.cast("string")).alias("id"), base, status.alias("status"))
    new = t(spark, sf, "customer").where(c % 5 != 0).select(F.concat(F.lit("R"), c.cast("string")).alias("id"), base, F.when(c % 7 == 0, "X").otherwise(status).alias("status"))
    matches = migration.match_rounds(old, new, [["base", "status"]])
    open_rows = migration.unresolved(old, new, matches, ["base"], ["status"])
    links = t(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("L"), F.col("o_custkey").cast("string")).alias("target_id"))
    counts = migration.rewrite(links, ["target_id"], matches).groupBy("target_id").agg(F.count(F.lit(1)).alias("n_links"))
    state = matches.select(F.col("old").alias("id"), F.lit("MATCHED").alias("code"), F.col("new").alias("target")).unionByName(open_rows.select("id", "code", F.col("candidate").alias("target")))
    end = F.when(F.col("code") == "MATCHED", F.col("target")).otherwise(F.col("id"))
    return state.withColumn("target_id", end).join(counts, "target_id", "left").select("id", "code", "target", F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""SELECT 'revisions' entity, 'v' || o_orderkey id, 'UNKNOWN_DOCUMENT_ID' code FROM orders WHERE o_custkey % 50 = 0
UNION ALL SELECT 'elements', 'e' || l_orderkey || '-' || l_linenumber, 'DUPLICATE_ID' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'elements', 'e' || l_orderkey || '-' || l_linenumber, CASE WHEN l_orderkey % 40 = 0 THEN 'PAGE_REFERENCE_NOT_FOUND' ELSE 'PAGE_REFERENCE_MISMATCH' END FROM lineitem WHERE l_orderkey % 40 IN (0, 1)
UNION ALL SELECT DISTINCT 'elements', 'e' || l_orderkey || '-' || l_linenumber, 'UNKNOWN_PAGE_ID' FROM lineitem WHERE l_orderkey % 40 = 0
UNION ALL SELECT 'links', 'k' || event_id, 'UNKNOWN_TARGET_ID' FROM events WHERE event_id % 30 = 0""")
def ingest_violations(spark, sf):
    """What may not be published: customers as documents, orders as revisions with a page each, lines as elements, events as links."""
    o, l, e = t(spark, sf, "orders"), t(spark, sf, "lineitem"), t(spark, sf, "events")

    def name(prefix, *columns):
        return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))

    none, box = F.lit(None).cast("string"), F.struct(F.lit(-5.0).alias("left"), F.lit(1.0).alias("bottom"), F.lit(900.0).alias("right"), F.lit(5.0).alias("top")).alias("bbox")
    documents = t(spark, sf, "customer").where("c_custkey % 50 <> 0").select(name("d", "c_custkey").alias("id"), F.lit("t").alias("title"))
    revisions = o.select(name("v", "o_orderkey").alias("id"), name("d", "o_custkey").alias("document_id"), F.lit("h").alias("source_hash"), F.lit(1).cast("long").alias("byte_size"), F.lit(1).alias("page_count"))
    pages = o.where("o_orderkey % 40 <> 0").select(name("p", "o_orderkey").alias("id"), name("v", "o_orderkey").alias("revision_id"), F.lit(1).alias("page_number"), F.lit(100.0).alias("width"), F.lit(50.0).alias("height"), F.lit(0.0).alias("origin_x"), F.lit(0.0).alias("origin_y"), F.lit(0).alias("rotation"), F.lit("MEDIA").alias("box_kind"))
    k = F.col("l_orderkey")
    page = F.when((k % 3 == 0) | (k % 40 <= 1), name("p", "l_orderkey"))
    number = F.when(k % 40 == 1, 2).otherwise(1)
    elements = l.select(name("e", "l_orderkey", "l_linenumber").alias("id"), page.alias("page_id"), name("v", "l_orderkey").alias("revision_id"), number.alias("page_number"), F.lit("p").alias("element_type"), F.lit("{}").alias("raw_json"), F.lit("x").alias("raw_text"), box, F.col("l_linenumber").alias("parser_order"))
    target = F.when(F.col("event_id") % 30 == 0, "nowhere").otherwise(F.lit(None).cast("string"))
    some = documents.agg(F.min("id").alias("some"))
    links = e.crossJoin(F.broadcast(some)).select(name("k", "event_id").alias("id"), F.col("some").alias("source_id"), F.coalesce(target, "some").alias("target_id"), F.lit("r").alias("relation_type"))
    empty = {n: spark.createDataFrame([], ingest.SCHEMAS[n]) for n in ("clauses", "tables", "visuals", "review_flags")}
    tables, unclear = ingest.prepared({"documents": documents, "revisions": revisions, "pages": pages, "elements": elements, "links": links, **empty})
    return unclear.distinct().unionByName(ingest.violations(tables))


@query("""WITH o AS (SELECT o_orderkey k, o_orderkey % 4 f, CAST(o_orderkey % 900 AS VARCHAR) a, CAST(o_orderkey % 500 AS VARCHAR) b, CAST(o_orderkey % 600 AS VARCHAR) c, o_custkey % 900 ra, o_custkey % 500 rb, 300 + o_custkey % 300 rc FROM orders)
SELECT k issue, 'minimum-area-threshold' facet, a fact, '' || ra threshold, CAST(a AS INT) >= ra satisfied FROM o WHERE f = 0
UNION ALL SELECT k, 'distance-normal-threshold', b, '' || rb, CAST(b AS INT) <= rb FROM o WHERE f IN (1, 2) UNION ALL SELECT k, 'distance-conditional-threshold', b, '' || (rb + 100), CAST(b AS INT) <= rb + 100 FROM o WHERE f = 2
UNION ALL SELECT k, 'semi-industrial-far-threshold', c, '' || rc, CAST(c AS INT) <= rc FROM o WHERE f = 3 AND rc >= 400""")
def facet_comparisons(spark, sf):
    """An issue per order: the facets that its question needs, the evidence that serves them, its facts against the thresholds."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    o = t(spark, sf, "orders")
    questions = F.array(*map(F.lit, ("최소 면적 기준은?", "승강장 거리 기준은?", "승강장 거리 조건은?", "준공업지역 용적률은?")))
    issues = o.select(c.alias("plan"), k.alias("issue"), F.element_at(questions, (k % 4 + 1).cast("int")).alias("question"))
    plans = o.select(c.alias("plan")).distinct().withColumn("question", F.lit("전체 질문."))
    states = F.array(text("면적 ", c % 900, "㎡ 이상"), text("승강장에서 ", c % 500, "m 이내, 다만 ", c % 500 + 100, "m 까지"), text("준공업지역 용적률 ", c % 300 + 300, "%"))
    evidence = o.select(c.alias("plan"), k.alias("issue"), F.posexplode(states).alias("n", "text")).withColumn("evidence", F.concat_ws("-", F.lit("e"), F.col("issue").cast("string"), F.col("n").cast("string")))
    facts = o.select(c.alias("plan"), k.alias("issue"), text("부지 ", k % 900, "㎡, 거리 ", k % 500, "m, ", k % 600, "%").alias("text"))
    required = facets.required_facets(issues, plans)
    covered = facets.coverage(required, facets.matched_facets(evidence.select("evidence", "text")), evidence.select("plan", "issue", "evidence"))
    return facets.comparisons(covered, facts, evidence.select("evidence", "text")).select("issue", "facet", "fact", "threshold", "satisfied")


@query("""WITH c AS (SELECT o_custkey run, o_orderkey claim, o_orderkey % 50 n FROM orders)
SELECT run, claim, 'UNREGISTERED_NUMBER' code, '' || n detail FROM c WHERE n <> run AND n NOT IN (SELECT CAST(l_quantity AS INT) FROM lineitem WHERE l_orderkey = claim)
UNION ALL SELECT run, claim, 'NUMERIC_TOKEN_MISMATCH', 'x' FROM c WHERE claim % 11 = 0 UNION ALL SELECT run, claim, 'UNSUPPORTED_NUMERIC_SYNTAX', '0:3: 1e9' FROM c WHERE claim % 13 = 0""")
def claim_number_errors(spark, sf):
    """An order claims its customer and a number, citing its lines."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o, l = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    odd = F.when(k % 13 == 0, "1e9 ").otherwise("")
    none = F.array().cast("array<string>")
    drafts = o.select(c.alias("run"), k.alias("claim"), F.concat(odd, F.lit("customer "), c.cast("string"), F.lit(" has "), (k % 50).cast("string")).alias("text"), none.alias("issues"), F.array(k.cast("string")).alias("citations"), F.when(k % 11 == 0, F.array(F.lit("x"))).otherwise(none).alias("tokens"), none.alias("calculations"))
    held = l.join(o, F.col("l_orderkey") == k).groupBy(c.alias("run"), F.col("l_orderkey").cast("string").alias("citation")).agg(F.array_join(F.sort_array(F.collect_set(F.col("l_quantity").cast("int").cast("string"))), " and ").alias("text"))
    inputs = o.select(c.alias("run"), F.concat(F.lit("customer "), c.cast("string")).alias("text")).distinct()
    calculations = spark.createDataFrame([], "run long, calculation string, status string, text string")
    compared = spark.createDataFrame([], "run long, issue string, evidence array<string>, fact string, threshold string")
    return claims.number_errors(drafts, held, inputs, calculations, compared)


@query("""WITH i AS (SELECT o_custkey run, count(*) n, count_if(o_orderstatus IN ('F', 'P')) ok FROM orders GROUP BY 1), m AS (SELECT DISTINCT o_custkey run FROM orders WHERE o_orderkey % 97 = 0)
SELECT c_custkey run, CASE WHEN c_nationkey % 7 = 0 OR coalesce(ok, 0) = 0 THEN 'ABSTAINED' WHEN m.run IS NOT NULL THEN 'NEEDS_INPUT' WHEN ok < n THEN 'PARTIAL' ELSE 'READY_FOR_REVIEW' END status, coalesce(ok, 0) n_resolved
FROM customer LEFT JOIN i ON i.run = c_custkey LEFT JOIN m ON m.run = c_custkey""")
def packet_states(spark, sf):
    """A packet per customer: orders are issues, some nations fail a gate, some orders lack an input."""
    c, o = t(spark, sf, "customer"), t(spark, sf, "orders")
    run = F.col("o_custkey").alias("run")
    status = F.when(F.col("o_orderstatus") == "F", "RESOLVED").when(F.col("o_orderstatus") == "P", "CONDITIONAL").otherwise("OPEN")
    issues = o.select(run, F.col("o_orderkey").alias("issue"), status.alias("status"))
    gates = c.select(F.col("c_custkey").alias("run"), F.lit("nation").alias("gate"), (F.col("c_nationkey") % 7 != 0).alias("passed"))
    missing = o.where("o_orderkey % 97 = 0").select(run, F.col("o_orderkey").cast("string").alias("item"))
    confidence = c.select(F.col("c_custkey").alias("run"), F.lit(0.5).alias("score"))
    made = packets.derive_packets(c.select(F.col("c_custkey").alias("run")), issues, gates, missing, missing.limit(0), confidence)
    return made.select("run", "status", F.get_json_object("packet", "$.n_resolved").cast("long").alias("n_resolved"))


@query("""SELECT p_partkey part, list_filter([CASE WHEN p_partkey % 13 = 0 THEN 'REVIEWER_MISSING' END, CASE WHEN p_partkey % 5 = 0 THEN 'CANDIDATE_HASH_MISMATCH' END, CASE WHEN p_partkey % 17 = 0 THEN 'APPROVED_HASH_MISMATCH' END, CASE WHEN p_partkey % 17 = 0 THEN 'APPROVED_DIFFERS_FROM_CANDIDATE' END,
CASE WHEN p_partkey % 7 = 0 THEN 'GOLDEN_MISSING' END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 11 = 0 THEN 'GOLDEN_HASH_MISMATCH' END, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 17 = 0 THEN 'GOLDEN_OF_OTHER_TEXT' END, CASE WHEN p_partkey % 7 <> 0 AND p_size > 40 THEN 'GOLDEN_FAILED' END], lambda x: x IS NOT NULL) codes FROM part""")
def approval_codes(spark, sf):
    """A rule per part, approved; what breaks the chain of hashes of some."""
    p = t(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("R"), F.col("p_partkey").cast("string")).alias("rule_id"), F.lit("1").alias("version"), F.concat(F.lit("text "), F.col("p_partkey").cast("string")).alias("text"), "p_size")
    results = p.where("k % 7 <> 0").select("rule_id", "version", F.lit("a").alias("case"), F.lit("SATISFIED").alias("expected"), F.when(F.col("p_size") > 40, "NOT_SATISFIED").otherwise("SATISFIED").alias("actual"), (F.col("p_size") <= 40).alias("passed"))
    reports = governance.golden_reports(results, p)
    own = F.sha2("text", 256)
    said = p.join(reports.select("rule_id", "report_hash").hint("merge"), "rule_id", "left")
    approvals = said.select(
        F.col("k").alias("approval"), "rule_id", "version", F.when(F.col("k") % 5 == 0, "x").otherwise(own).alias("candidate_hash"), own.alias("approved_hash"), F.when(F.col("k") % 11 == 0, "x").otherwise(F.coalesce("report_hash", F.lit("none"))).alias("report_hash"),
        F.when(F.col("k") % 13 == 0, "").otherwise("ann").alias("reviewer"), F.lit("2026-01-01").alias("reviewed_at"),
    )
    approved = p.withColumn("text", F.when(F.col("k") % 17 == 0, "changed").otherwise(F.col("text")))
    return governance.verify_approvals(approvals, p, approved, reports).select(F.col("approval").alias("part"), "codes")


@query("""WITH o AS (SELECT o_orderkey k, o_custkey c FROM orders) SELECT k source, 1 page, 'NOT_ON_AXIS' code FROM o WHERE k % 37 = 0 UNION ALL SELECT k, 1, 'LENGTH_NOT_POSITIVE' FROM o WHERE c % 100 = 0
UNION ALL SELECT k, 1, 'UNITS_DIFFER' FROM o WHERE k % 11 = 0 UNION ALL SELECT k, 1, 'AXIS_TWICE' FROM o WHERE k % 13 = 0 UNION ALL SELECT k, 1, 'REVIEWER_INVALID' FROM o WHERE k % 17 = 0""")
def calibration_errors(spark, sf):
    """Two calibration references for every order, some of which can't be used."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = lambda col: col.cast("string")
    zero, one = F.lit("0"), F.lit("1")
    x = F.struct(F.lit("x").alias("axis"), zero.alias("x1"), one.alias("y1"), text(k % 37).alias("x2"), one.alias("y2"), F.lit("m").alias("unit"))
    y = F.struct(F.when(k % 13 == 0, "x").otherwise("y").alias("axis"), one.alias("x1"), zero.alias("y1"), F.when(k % 13 == 0, "9").otherwise("1").alias("x2"), F.when(k % 13 == 0, "0").otherwise("9").alias("y2"), F.when(k % 11 == 0, "ft").otherwise("m").alias("unit"))
    flat = t(spark, sf, "orders").select(k.alias("source"), F.lit(1).alias("page"), text(c % 100).alias("real"), F.when(k % 17 == 0, "a/b").otherwise("ann").alias("reviewer"), F.explode(F.array(x, y)).alias("r"))
    return drawings.reference_errors(flat.select("source", "page", "real", "reviewer", "r.*"))


@query("""WITH s AS (SELECT o_custkey c, bool_or(o_orderkey % 500 = 0) broken, bool_or(o_orderkey % 500 = 0 OR o_orderstatus = 'P' OR o_totalprice > 400000) rejected FROM orders GROUP BY 1)
SELECT c_custkey "case", CASE WHEN broken THEN 'FAILED' WHEN rejected THEN 'BLOCKED' WHEN broken IS NULL THEN 'PENDING_DRAWING_INGESTION' WHEN c_custkey % 9 = 0 OR c_custkey % 8 = 0 THEN 'INPUT_CONFIRMATION_REQUIRED' WHEN c_custkey % 2 = 0 THEN 'READY_TO_EVALUATE' ELSE 'INPUT_CONFIRMATION_REQUIRED' END state FROM customer LEFT JOIN s ON c = c_custkey""")
def drawing_case_states(spark, sf):
    """Customers as cases, orders as their drawings: quality of each source, then the state of the case."""
    o, c = t(spark, sf, "orders"), t(spark, sf, "customer")
    k, status = F.col("o_orderkey"), F.col("o_orderstatus")
    mime = F.when(status == "P", "text/plain").when(status == "F", "image/png").otherwise("application/pdf")
    sources = o.select(
        F.col("o_custkey").alias("case"), k.alias("source"), k.alias("ord"), F.lit("h").alias("sha256"), F.when(k % 500 == 0, "x").otherwise("h").alias("seen_sha256"), F.col("o_totalprice").cast("long").alias("byte_size"), mime.alias("mime"),
        F.lit("SUCCESS").alias("outcome"), F.lit(3).alias("pages"), F.lit(10).alias("width"), F.lit(10).alias("height"), F.lit(False).alias("lossy"), F.lit("USER_CONFIRMED").alias("trust"),
    )
    n = F.col("c_custkey")
    inputs = c.select(n.alias("case"), (n % 9 == 0).alias("conflict"), (n % 8 == 0).alias("missing"), (n % 2 == 0).alias("validated"))
    assessed = drawings.assess(sources, drawings.Policy(max_file_bytes=400_000, max_case_image_pixels=1 << 40))
    return drawings.case_states(c.select(n.alias("case")), assessed, inputs).select("case", "state")
