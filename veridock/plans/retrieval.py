"""Registered queries over the stored index: top k, channels, the cascade and issue-aware retrieval. Each with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veridock.functions.text import tokens
from veridock.operators import cascade, hybrid, inverted_index, issue_retrieval, search
from veridock.operators.budgets import RetrievalPolicy
from veridock.plans.relational import t
from veridock.plans.review import TOK

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLE[fn.__name__] = sql
        return fn

    return keep


def _index(spark, sf) -> inverted_index.Index:
    """The stored index of the documents, built by the first query that needs it."""
    return inverted_index.stored(inverted_index.documents(t(spark, sf, "documents"), "doc_id", "text"))


def _items(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select("item_id", tokens(F.col("text")).alias("w"))


PART = "f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))"
IDF = "greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6)"


def _matches(attempts: str) -> str:
    """CTEs: documents d, statistics st, attempts att (q, ord, stage, kind, ts), and sc (q, ord, doc_id, score) of the documents that hold all words."""
    return f"""d AS (SELECT doc_id, {TOK} w FROM documents), st AS (SELECT count(*) n, avg(len(w)) avgdl FROM d), att AS ({attempts}),
f AS (SELECT q, ord, doc_id, len(w) dl, slot, CASE kind WHEN 'phrase' THEN 1 ELSE len(ts) END slots,
CASE kind WHEN 'phrase' THEN len(list_filter(range(1, len(w) - len(ts) + 2), lambda i: w[i:i + len(ts) - 1] = ts)) WHEN 'tokens' THEN len(list_filter(w, lambda x: x = ts[slot])) ELSE len(list_filter(w, lambda x: starts_with(x, ts[slot]))) END f
FROM (SELECT *, unnest(range(1, CASE kind WHEN 'phrase' THEN 2 ELSE len(ts) + 1 END)) slot FROM att), d),
df AS (SELECT q, ord, slot, count(*) df FROM f WHERE f > 0 GROUP BY ALL),
sc AS (SELECT q, ord, doc_id, round(sum({IDF} * {PART}), 12) score FROM f JOIN df USING (q, ord, slot), st WHERE f > 0 GROUP BY q, ord, doc_id, slots HAVING count(*) = slots)"""


@query(f"""WITH d AS (SELECT doc_id, {TOK} w FROM documents), s AS (SELECT count(*) n, avg(len(w)) avgdl FROM d), q AS (SELECT DISTINCT item_id q, unnest(({TOK})[1:4]) term FROM benchmark),
tf AS (SELECT q, doc_id, len(w) dl, term, len(list_filter(w, lambda x: x = term)) f FROM d, q), df AS (SELECT term, count(DISTINCT doc_id) df FROM tf WHERE f > 0 GROUP BY 1),
sc AS (SELECT q, doc_id, round(sum({IDF} * {PART}), 12) score FROM tf JOIN df USING (term), s WHERE f > 0 GROUP BY 1, 2)
SELECT q, doc_id "key", score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) rank FROM sc QUALIFY rank <= 10""")
def index_topk(spark, sf):
    """For every benchmark item the ten documents that go best with any of its first four words."""
    asked = _items(spark, sf).select(F.col("item_id").alias("q"), F.slice("w", 1, 4).alias("terms"))
    return inverted_index.top_k(_index(spark, sf), asked, 10)


@query(f"""WITH {_matches(f"SELECT item_id q, c ord, '' stage, ['phrase', 'tokens', 'prefixes'][c] kind, ({TOK})[1:2] ts FROM benchmark, range(1, 4) x(c)")},
r AS (SELECT *, row_number() OVER (PARTITION BY q, ord ORDER BY score DESC, doc_id) rank FROM sc QUALIFY rank <= 10)
SELECT q, doc_id "key", round(sum((1.0 / rank) * [0.55, 0.15, 0.12][ord]), 6) final_score, string_agg(['fts_phrase', 'fts_token_and', 'fts_token_prefix_and'][ord], '|' ORDER BY ord) channels FROM r GROUP BY 1, 2""")
def index_channels(spark, sf):
    """The full-text channels of every item's first two words, fused."""
    asked = _items(spark, sf).select(F.col("item_id").alias("q"), F.slice("w", 1, 2).alias("terms"))
    hits = inverted_index.channels(_index(spark, sf), asked, 10).select(F.struct("q", "key").alias("hit"), "channel", "rank", "score")
    return search.fuse(hits, "hit").select("hit.q", "hit.key", "final_score", "channels")


CASCADE = f"""SELECT q, ord, stage, kind, list_filter(ts, lambda x: x <> '') ts FROM (SELECT item_id q, unnest(CASE item_id % 4
WHEN 0 THEN [{{'ord': 1, 'stage': 'PHRASE', 'kind': 'phrase', 'ts': w[1:3]}}, {{'ord': 2, 'stage': 'TOKEN_AND', 'kind': 'tokens', 'ts': w[1:3]}}, {{'ord': 3, 'stage': 'TOKEN_PREFIX', 'kind': 'prefixes', 'ts': w[1:3]}},
  {{'ord': 4, 'stage': 'CORE_TOKEN_AND', 'kind': 'prefixes', 'ts': w[2:3]}}, {{'ord': 5, 'stage': 'CORE_TOKEN_AND', 'kind': 'prefixes', 'ts': [w[1], w[3]]}}, {{'ord': 6, 'stage': 'CORE_TOKEN_AND', 'kind': 'prefixes', 'ts': w[1:2]}}]
WHEN 1 THEN [{{'ord': 1, 'stage': 'PHRASE', 'kind': 'phrase', 'ts': [w[3], w[1]]}}, {{'ord': 2, 'stage': 'TOKEN_AND', 'kind': 'tokens', 'ts': [w[3], w[1]]}}, {{'ord': 3, 'stage': 'TOKEN_PREFIX', 'kind': 'prefixes', 'ts': [w[3], w[1]]}}]
WHEN 2 THEN [{{'ord': 5, 'stage': 'FACT_DECONTAMINATED', 'kind': 'prefixes', 'ts': w[1:2]}}]
ELSE [{{'ord': 6, 'stage': 'CORE_TOKEN_AND', 'kind': 'prefixes', 'ts': w[1:2]}}] END, recursive := true) FROM (SELECT item_id, {TOK} w FROM benchmark))"""


@query(f"""WITH {_matches(CASCADE)}, b AS (SELECT q, min(ord) ord FROM sc GROUP BY 1)
SELECT q, stage, doc_id "key", CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INT) rank FROM sc JOIN b USING (q, ord) JOIN att USING (q, ord) QUALIFY rank <= 5""")
def fallback_cascade(spark, sf):
    """A query per benchmark item: three words in a row, two words turned round, two with the case's own amount, two with a word that no document has."""
    w, item = F.col("w"), F.col("item_id") % 4
    own = F.array(F.lit("facts 12 m"))
    text = F.when(item == 0, F.array_join(F.slice(w, 1, 3), " ")).when(item == 1, F.concat_ws(" ", w[2], w[0])).when(item == 2, F.concat_ws(" ", w[0], w[1], F.lit("12m"))).otherwise(F.concat_ws(" ", w[0], w[1], F.lit("zzzqqq")))
    asked = _items(spark, sf).select(F.col("item_id").alias("q"), text.alias("text"), F.when(item == 2, own).alias("facts"))
    hits, _ = cascade.fall_through(_index(spark, sf), asked, 5)
    return hits.select("q", "stage", "key", "rank")


REQUESTS = f"""SELECT item_id plan, item_id * 10 + r % 2 issue, r % 2 issue_pos, 'role' || (r % 3) role, r % 3 role_pos, item_id * 10 + r request, r ord, w[r:r + 1] ts FROM (SELECT item_id, {TOK} w FROM benchmark), range(1, 8) x(r)"""


@query(f"""WITH rq AS ({REQUESTS}), turn AS (SELECT *, row_number() OVER (PARTITION BY issue, role ORDER BY ord, request) depth FROM rq),
pl AS (SELECT *, row_number() OVER (PARTITION BY issue ORDER BY depth, role_pos) place FROM turn),
{_matches("SELECT request q, c ord, ['PHRASE', 'TOKEN_AND', 'TOKEN_PREFIX'][c] stage, ['phrase', 'tokens', 'prefixes'][c] kind, ts FROM pl, range(1, 4) x(c) WHERE place <= 2")},
b AS (SELECT q, min(ord) ord FROM sc GROUP BY 1), h AS (SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) rk FROM sc JOIN b USING (q, ord) QUALIFY rk <= 3),
bu AS (SELECT plan, issue_pos, role_pos, doc_id, max(score) score FROM h JOIN pl ON pl.request = h.q GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY plan, issue_pos, role_pos ORDER BY score DESC, doc_id) rk FROM bu QUALIFY rk <= 3),
fi AS (SELECT plan, doc_id, min((rk, issue_pos, role_pos)) fst FROM rk GROUP BY 1, 2), ch AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY fst) place FROM fi),
el AS (SELECT doc_id, i n, doc_id || '#' || i ev FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) ln FROM documents), range(1, 3) y(i) WHERE i <= ln),
ev AS (SELECT plan, doc_id, ev, place, n FROM ch JOIN el USING (doc_id) WHERE place <= 5), evp AS (SELECT plan, ev, row_number() OVER (PARTITION BY plan ORDER BY place, n) p FROM ev)
SELECT 'candidate' AS kind, plan, CAST(place AS INT) place, CAST(doc_id AS VARCHAR) item, CAST(NULL AS VARCHAR) reason FROM ch WHERE place <= 5
UNION ALL SELECT 'evidence', plan, CAST(p AS INT), ev, NULL FROM evp WHERE p <= 7
UNION ALL SELECT DISTINCT 'limited', plan, CAST(NULL AS INT), CAST(doc_id AS VARCHAR), NULL FROM ev JOIN evp USING (plan, ev) WHERE p > 7
UNION ALL SELECT 'drop', plan, CAST(request AS INT), CAST(NULL AS VARCHAR), 'QUERY_BUDGET' FROM pl WHERE place > 2
UNION ALL SELECT DISTINCT 'drop', ch.plan, CAST(pl.request AS INT), CAST(ch.doc_id AS VARCHAR), 'CANDIDATE_BUDGET' FROM ch JOIN rk ON rk.plan = ch.plan AND rk.doc_id = ch.doc_id
  JOIN pl ON pl.plan = ch.plan AND pl.issue_pos = rk.issue_pos AND pl.role_pos = rk.role_pos JOIN h ON h.q = pl.request AND h.doc_id = ch.doc_id WHERE ch.place > 5""")
def issue_retrieval_bundle(spark, sf):
    """Seven requests of two issues and three roles for every benchmark item, from requests to selected evidence and drops."""
    r = F.col("r")
    made = _items(spark, sf).select("item_id", "w", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("r"))
    requests = made.select(
        F.col("item_id").alias("plan"), (F.col("item_id") * 10 + r % 2).alias("issue"), (r % 2).alias("issue_pos"), F.concat(F.lit("role"), (r % 3).cast("string")).alias("role"), (r % 3).alias("role_pos"),
        (F.col("item_id") * 10 + r).alias("request"), r.alias("ord"), F.array_join(F.slice("w", r, F.lit(2)), " ").alias("text"),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    elements = t(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.posexplode(F.slice(lines, 1, 5)).alias("ord", "line"))
    elements = elements.select("key", "ord", F.concat_ws("#", F.col("key").cast("string"), (F.col("ord") + 1).cast("string")).alias("evidence"))
    policy = RetrievalPolicy(max_queries_per_issue=2, max_candidates_per_role=3, global_candidate_cap=5, max_selected_evidence=7, max_source_elements_per_clause=2)
    b = issue_retrieval.retrieve(_index(spark, sf), requests, elements, policy)
    none = F.lit(None).cast("string")
    parts = [
        b.candidates.select(F.lit("candidate").alias("kind"), "plan", "place", F.col("key").cast("string").alias("item"), none.alias("reason")),
        b.evidence.select(F.lit("evidence"), "plan", "place", "evidence", none),
        b.budget_limited.select(F.lit("limited"), "plan", F.lit(None).cast("int"), F.col("key").cast("string"), none),
        b.drops.select(F.lit("drop"), "plan", F.col("request").cast("int"), F.col("key").cast("string"), "reason"),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query(f"""WITH {_matches(f"SELECT item_id q, c ord, '' stage, ['phrase', 'tokens', 'prefixes', 'tokens'][c] kind, CASE c WHEN 4 THEN [w[1] || w[2]] ELSE w[1:2] END ts FROM (SELECT item_id, {TOK} w FROM benchmark), range(1, 5) x(c)")},
lx AS (SELECT q, ord, doc_id, row_number() OVER (PARTITION BY q, ord ORDER BY score DESC, doc_id) rank FROM sc QUALIFY rank <= 5),
seed AS (SELECT DISTINCT q, doc_id FROM lx WHERE ord < 4), side AS (SELECT q, n.doc_id, row_number() OVER (PARTITION BY q ORDER BY n.doc_id) rank FROM (SELECT DISTINCT q, unnest([doc_id - 1, doc_id + 1]) doc_id FROM seed) n JOIN documents USING (doc_id) WHERE (q, n.doc_id) NOT IN (SELECT (q, doc_id) FROM seed) QUALIFY rank <= 5),
vis AS (SELECT q, doc_id // 2 * 2 + 1 doc_id, max(1.0 / rank) score FROM lx WHERE ord < 4 GROUP BY 1, 2), vr AS (SELECT q, doc_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) rank FROM vis QUALIFY rank <= 5),
lab AS (SELECT item_id q, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) rank FROM benchmark JOIN documents ON doc_id % 1000 = item_id QUALIFY rank <= 5),
al AS (SELECT q, doc_id, ['fts_phrase', 'fts_token_and', 'fts_token_prefix_and', 'fts_korean_compound'][ord] c, [0.55, 0.15, 0.12, 0.35][ord] wt, rank FROM lx UNION ALL SELECT q, doc_id, 'structural_context', 0.08, rank FROM side
UNION ALL SELECT q, doc_id, 'linked_visual_table', 0.6, rank FROM vr UNION ALL SELECT q, doc_id, 'rule_source', 0.9, rank FROM lab),
fu AS (SELECT q, doc_id "key", round(sum((1.0 / rank) * wt), 6) final_score, string_agg(c, '|' ORDER BY c) channels FROM al GROUP BY 1, 2)
SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY final_score DESC, "key") AS INT) rank FROM fu QUALIFY rank <= 10""")
def hybrid_bundle(spark, sf):
    """Two words of every benchmark item through the channels: lexical, compounds, rule sources, linked tables and neighbours, fused."""
    docs = t(spark, sf, "documents").select(F.col("doc_id").alias("key"))
    asked = _items(spark, sf).select(F.col("item_id").alias("q"), F.array_join(F.slice("w", 1, 2), " ").alias("text"))
    rules = docs.select((F.col("key") % 1000).alias("q"), "key")
    links = docs.select(F.col("key").alias("source"), (F.floor(F.col("key") / 2) * 2 + 1).alias("target"))
    places = docs.select("key", F.lit(0).alias("group"), F.col("key").alias("pos"))
    index = _index(spark, sf)
    return hybrid.fused(hybrid.bundle(index, asked, 5, rule_sources=rules, links=links, places=places), 10)
