"""The queries of the corpus operators, over whole tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm.chat_format import format_conversations
from tidelane.llm.collocations import collocations
from tidelane.llm.common import table
from tidelane.llm.decontamination import overlaps
from tidelane.llm.hard_negatives import hard_negatives
from tidelane.llm.jaccard_join import similar_documents
from tidelane.llm.license_scan import scan
from tidelane.llm.packing import pack
from tidelane.llm.quality import quality
from tidelane.llm.quality_rules import quality_rules
from tidelane.llm.suffix_dedup import remove_repeats
from tidelane.llm.suffix_tree_lm import scored
from tidelane.llm.top_k import top_k
from tidelane.llm.toxicity import toxicity


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(table(spark, sf_dir, "conversations"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, id_, label = table(spark, sf_dir, "embeddings"), F.col("vec_id"), F.col("label").cast("long")
    moved = F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(vectors.withColumn("label", moved), id_ % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_license_scan": op4_license_scan,
    "op5_top_k": op5_top_k,
    "op6_toxicity": op6_toxicity,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_quality": op8_quality,
    "op9_suffix_tree_lm": op9_suffix_tree_lm,
    "op10_packing": op10_packing,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_collocations": op12_collocations,
    "op13_quality_rules": op13_quality_rules,
}

OP1_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
    FROM d
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
    SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r AS (
    SELECT doc_id AS node, doc_id AS reached FROM documents UNION SELECT r.node, e.y FROM r JOIN e ON e.x = r.reached
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, t.first_id
FROM d
LEFT JOIN n USING (doc_id)
JOIN (SELECT node AS doc_id, min(reached) AS component_id FROM r GROUP BY node) c USING (doc_id)
JOIN (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents) t USING (doc_id)
"""

OP5_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
    SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p
QUALIFY rank <= 10
"""

OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
), p AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank, s.other_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""

OP12_SQL = """
WITH d AS (
    SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
    SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), s AS (
    SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), n AS (
    SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM s GROUP BY lang
), g AS (
    SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM s, range(1, 6) r(m) WHERE len(w) >= m
), f AS (
    SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100
), c AS (
    SELECT lang, m, phrase, a, unnest(range(1, m)) AS k FROM f
    WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM f x WHERE x.lang = f.lang AND x.m > f.m AND 100 * x.a >= 100 * f.a AND contains(' ' || x.phrase || ' ', ' ' || f.phrase || ' '))
), q AS (
    SELECT c.lang, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n.n, CAST((CAST(1000 AS HUGEINT) * c.a * n.n) // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
    FROM c JOIN n ON n.lang = c.lang
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(string_split(c.phrase, ' ')[1:c.k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(string_split(c.phrase, ' ')[c.k + 1:], ' ')
), o AS (
    SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= 2000
"""

#: The other operators learn, hash, align or pack in ways that SQL can't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op5_top_k": OP5_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_collocations": OP12_SQL,
}
