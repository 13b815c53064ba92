"""The registered queries of the text operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm import bpe, chat, decontaminate, html, langid, licenses, line_dedup, near_dedup, quality, token_counts
from weirflow.llm.common import table

#: The conversation that every run formats besides the table's.
EXTRA_CHAT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, r.turn AS turn, r.role AS role, :text AS text FROM (SELECT explode(array(named_struct('turn', 0L, 'role', 'user'), named_struct('turn', 1L, 'role', 'assistant'))) AS r)", {"text": EXTRA_CHAT})
    made = chat.format_chats(rows.unionByName(extra)).withColumn("turns", chat.read_back(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"])), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.license_scan(docs, keep=["doc_id"]).select("doc_id", "n_licenses", F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"), F.array_join(F.transform("licenses", lambda x: x["first_line"].cast("string")), ",").alias("lines"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"], with_ids=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    model = langid.learn(docs.filter("not held_out"))
    return langid.languages(docs, model, keep=["doc_id", "held_out"]).drop("spans")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_h1", "text_h2")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_chat_format, op2_license_scan, op3_decontaminate, op4_bpe, op5_language_id, op6_html_text, op7_line_dedup, op8_near_dedup, op9_token_counts, op10_quality, pipeline]
    return {f.__name__: f for f in found}


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER w AS before, regexp_replace(text, '(\\*)(</?s>|\[/?INST\]|<\|[^|<>]*\|>)', '\\\1\2', 'g') AS escaped
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(length(escaped) + CASE WHEN before = role THEN 10 ELSE 10 + length(role) + 9 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP7_SQL = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS raw, list_transform(string_split(text, chr(10)), lambda x: trim(x)) AS l FROM documents WHERE text IS NOT NULL),
wins AS (
  SELECT doc_id, i AS pos, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM split WHERE len(l) >= 3)
  WHERE l[i] <> '' OR l[i + 1] <> '' OR l[i + 2] <> ''
),
ranked AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS rn FROM wins),
covered AS (SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) AS t(k) WHERE rn > 1),
lines AS (SELECT doc_id, unnest(range(1, len(raw) + 1)) AS pos, unnest(raw) AS x FROM split),
kept AS (
  SELECT lines.doc_id, count(*) AS n_lines, count(covered.pos) AS n_removed, coalesce(string_agg(x, chr(10) ORDER BY lines.pos) FILTER (covered.pos IS NULL), '') AS text
  FROM lines LEFT JOIN covered USING (doc_id, pos) GROUP BY lines.doc_id
)
SELECT d.doc_id, kept.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN kept USING (doc_id)
"""


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP3_SQL = rf"""
WITH dw AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, w, least(len(w), 10) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM iw)),
places AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM places JOIN win USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8_SQL = rf"""
WITH RECURSIVE dw AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(x) AS h, x FROM (
    SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM dw WHERE len(w) >= 5)
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM dw WHERE len(w) BETWEEN 1 AND 4
  )
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT x, y FROM edges UNION SELECT reach.doc_id, edges.y FROM reach JOIN edges ON reach.r = edges.x),
least_of AS (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, least(dw.doc_id, coalesce(r, dw.doc_id)) AS component_id, least(dw.doc_id, coalesce(r, dw.doc_id)) = dw.doc_id AS kept
FROM dw LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1_SQL, "op3_decontaminate": OP3_SQL, "op7_line_dedup": OP7_SQL, "op8_near_dedup": OP8_SQL}
