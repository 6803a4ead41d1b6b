"""Queries of the training-data operators, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language_id import language_id
from .licenses import license_scan
from .line_dedup import line_dedup
from .near_dup import near_duplicates
from .periodic_runs import periodic_runs, planted, strongest
from .pii import pseudonymize
from .prefix_trie import conversation_trie
from .secret_scan import secret_scan
from .sp_codec import sentencepiece_codec
from .token_store import token_output
from .toxicity import toxicity

#: The key of the surrogates in the registered query; a user passes their own.
DEMO_KEY = b"demonstration key"


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(_table(spark, sf_dir, "documents"), DEMO_KEY)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform(lines, lambda t: F.concat(t, F.lit("\n")))), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


_ALL = (
    op1_line_dedup,
    op2_toxicity,
    op3_near_dup,
    op4_sentencepiece,
    op5_pii_surrogates,
    op6_secret_scan,
    op7_decontaminate,
    op8_exact_dedup,
    op9_license_scan,
    op10_token_output,
    op11_periodic_runs,
    op12_language_id,
    op13_prefix_trie,
)
QUERIES = {f.__name__: f for f in _ALL}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP7 = f"""
WITH iw AS (SELECT CAST(item_id AS VARCHAR) item_id, {WORDS} ws FROM benchmark),
windows AS (SELECT item_id, unnest([array_to_string(list_slice(ws, i, i + 9), ' ') FOR i IN range(1, greatest(len(ws) - 10, 0) + 2)]) gram,
            least(len(ws), 10) n FROM iw WHERE len(ws) > 0),
grams AS (SELECT DISTINCT gram, n FROM windows),
lens AS (SELECT DISTINCT n FROM grams),
dw AS (SELECT doc_id, {WORDS} ws FROM documents),
starts AS (SELECT doc_id, ws, lens.n, unnest(range(1, len(ws) - lens.n + 2)) s FROM dw, lens WHERE len(ws) >= lens.n),
hits AS (SELECT doc_id, s, st.n, g.gram FROM starts st JOIN grams g ON g.n = st.n AND g.gram = array_to_string(list_slice(ws, s, s + st.n - 1), ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) n_items, string_agg(item_id, ',' ORDER BY item_id) items FROM
        (SELECT DISTINCT h.doc_id, w.item_id FROM hits h JOIN windows w ON w.gram = h.gram AND w.n = h.n) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
       sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM dw LEFT JOIN pos ON pos.doc_id = dw.doc_id LEFT JOIN its ON its.doc_id = dw.doc_id
"""

OP8 = f"""
WITH n AS (SELECT doc_id, {LOWER} t FROM documents)
SELECT doc_id, max(doc_id) OVER w keep_id, CAST(count(*) OVER w AS BIGINT) group_size, doc_id = max(doc_id) OVER w kept, sha256(t) text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

#: Unsigned crc32 of a decimal number, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
    lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, zero: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

OP13 = rf"""
WITH turns AS (SELECT conv_id c, turn, coalesce(role, '') role, strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '') k,
               len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) words FROM conversations WHERE conv_id IS NOT NULL),
paths AS (SELECT c, list({{'k': k, 'words': words}} ORDER BY turn NULLS FIRST, role, sha256(k)) path FROM turns GROUP BY c),
hs AS (SELECT c, path, {CRC} % 4 h FROM paths),
built AS (SELECT hs.c, list_concat(coalesce(list_slice(b.path, 1, h), []), list_slice(hs.path, h + 1, len(hs.path))) path
          FROM hs LEFT JOIN paths b ON b.c = hs.c - hs.c % 20),
pre AS (SELECT c, len(path) n, path, unnest(range(0, len(path) + 1)) d FROM built),
nodes AS (SELECT list_transform(list_slice(path, 1, d), lambda t: t.k) ks, d, min(c) conv_id, count(*) n_convs, coalesce(any_value(path[d].words), 0) words,
          coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '') ends FROM pre GROUP BY ALL),
kids AS (SELECT list_slice(ks, 1, d - 1) ks, count(*) n FROM nodes WHERE d > 0 GROUP BY 1),
own AS (SELECT nodes.*, coalesce(kids.n, 0) n_children FROM nodes LEFT JOIN kids ON kids.ks = nodes.ks),
up AS (SELECT n_children, (n_convs - 1) * words saved, ks, unnest(range(0, d + 1)) a FROM own),
subtree AS (SELECT list_slice(ks, 1, a) ks, count(*) FILTER (WHERE n_children = 0) n_leaves, sum(saved) saved FROM up GROUP BY 1)
SELECT o.conv_id, CAST(o.d AS BIGINT) depth, p.conv_id parent_conv_id, CAST(o.n_convs AS BIGINT) n_convs, CAST(o.n_children AS BIGINT) n_children,
       CAST(s.n_leaves AS BIGINT) n_leaves, CAST(s.saved AS BIGINT) saved_tokens, sha256(o.ends) ends_sha256
FROM own o JOIN subtree s ON s.ks = o.ks LEFT JOIN own p ON o.d > 0 AND p.ks = list_slice(o.ks, 1, o.d - 1)
"""

ORACLE = {"op7_decontaminate": OP7, "op8_exact_dedup": OP8, "op13_prefix_trie": OP13}
