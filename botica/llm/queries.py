"""The named queries of this subpackage, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from botica.llm import (
    embeddings,
    exact,
    hpylm,
    langid,
    merkle,
    mixing,
    negatives,
    ngrams,
    packing,
    passages,
    quality,
    sharding,
    urls,
)
from botica.llm.staging import table


def word_bpe() -> str:
    import public_tokenizers

    return Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), word_bpe(), end_id=1)
    return packed.select(
        F.col("id").alias("doc_id"),
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"))
    return placed.select(
        F.col("id").alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    copies = exact.exact_copies(table(spark, sf_dir, "documents"))
    return copies.withColumnsRenamed({"id": "doc_id", "sha256": "text_sha256"})


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sources(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.language_model(table(spark, sf_dir, "documents"))
    return langid.page_languages(table(spark, sf_dir, "pages"), model).withColumnRenamed("id", "page_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumnRenamed("id", "doc_id")


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id").drop("url")


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_copies(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaves = merkle.manifest(table(spark, sf_dir, "documents"), tampered=chosen)
    return leaves.withColumnRenamed("id", "doc_id")


def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").drop("spans", "kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_mixing": op5_mixing,
    "op6_language_id": op6_language_id,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filters": op8_url_filters,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_suffix_array_dedup": op13_suffix_array_dedup,
}

ORACLE: dict[str, str] = {
    "op4_exact_dedup": """
        WITH texts AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents
        ), grouped AS (
            SELECT doc_id, t, max(doc_id) OVER (PARTITION BY t) AS keep_id,
                   count(*) OVER (PARTITION BY t) AS group_size
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM grouped
    """,
    "op5_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
            FROM documents
        ), sources AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), weighed AS (
            SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
            FROM sources
        ), ordered AS (
            SELECT *, CAST(3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER before, 0)
                           AS BIGINT) AS twice_left,
                   CAST(sum(weight) OVER rest AS BIGINT) AS weights,
                   row_number() OVER by_need AS place
            FROM weighed
            WINDOW by_need AS (ORDER BY source_size / weight, source NULLS LAST),
                   before AS (ORDER BY source_size / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   rest AS (ORDER BY source_size / weight, source NULLS LAST
                            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
        ), level AS (
            SELECT place AS first, twice_left, weights FROM ordered
            WHERE 4 * source_size * weights >= twice_left * weight
            ORDER BY place LIMIT 1
        ), targets AS (
            SELECT o.source, o.source_size,
                   CASE WHEN o.place < l.first THEN CAST(2 * o.source_size AS DOUBLE)
                        ELSE CAST(50 * o.weight * l.twice_left AS DOUBLE)
                             / CAST(100 * l.weights AS DOUBLE) END AS target
            FROM ordered o CROSS JOIN level l
        ), placed AS (
            SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target + 0.5) AS quota,
                   coalesce(sum(s.size) OVER (
                       PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
        )
        SELECT doc_id, size, source_size, target,
               CAST(greatest(0, least(size, quota - begin))
                    + greatest(0, least(size, quota - begin - source_size)) AS BIGINT) AS taken
        FROM placed
    """,
    "op11_hard_negatives": r"""
        WITH valid AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id,
                   CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM valid a JOIN valid b ON a.vec_id != b.vec_id
            WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), ranked AS (
            SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                                           ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
            FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
             AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
        )
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 5
    """,
    "op12_merkle_manifest": r"""
        WITH RECURSIVE shown AS (
            SELECT doc_id, lang, source, n_chars, text,
                   CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
                   list_reduce(
                       list_concat([4294967295::BIGINT], flatten(list_transform(
                           string_split(CAST(doc_id AS VARCHAR), ''),
                           lambda c: list_transform(range(8), lambda b: CAST((ord(c) >> b) & 1 AS BIGINT))))),
                       lambda crc, bit: xor(crc >> 1, 3988292384 * (xor(crc, bit) & 1))) AS inverse
            FROM documents
        ), stated AS (
            SELECT doc_id, tree, xor(inverse, 4294967295) % 7 = 0 AS tampered,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
                   || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') AS head,
                   coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars,
                   coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') AS more,
                   coalesce(strlen(text) || ':' || text, '-') AS tail
            FROM shown
        ), leaves AS (
            SELECT doc_id, tree, sha256(head || chars || tail) AS leaf,
                   sha256(head || CASE WHEN tampered THEN more ELSE chars END || tail) AS shown
            FROM stated
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS slot
            FROM leaves
        ), nodes AS (
            SELECT tree, 0 AS level, slot, leaf AS node, count(*) OVER (PARTITION BY tree) AS n FROM placed
            UNION ALL
            SELECT tree, level, slot, node, n FROM (
                SELECT tree, level + 1 AS level, slot // 2 AS slot, slot % 2 AS half, (n + 1) // 2 AS n,
                       sha256(node || coalesce(lead(node) OVER (PARTITION BY tree ORDER BY slot), '')) AS node
                FROM nodes WHERE n > 1
            ) WHERE half = 0
        ), subroots AS (
            SELECT tree, node AS subroot, row_number() OVER (ORDER BY encode(tree)) - 1 AS place,
                   count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ), upper AS (
            SELECT 0 AS level, place AS slot, subroot AS node, n FROM subroots
            UNION ALL
            SELECT level, slot, node, n FROM (
                SELECT level + 1 AS level, slot // 2 AS slot, slot % 2 AS half, (n + 1) // 2 AS n,
                       sha256(node || coalesce(lead(node) OVER (ORDER BY slot), '')) AS node
                FROM upper WHERE n > 1
            ) WHERE half = 0
        ), steps AS (
            SELECT p.tree, p.slot, n.level, o.node AS other, (p.slot >> n.level) % 2 = 1 AS after
            FROM placed p JOIN nodes n ON n.tree = p.tree AND n.slot = p.slot >> n.level AND n.n > 1
            LEFT JOIN nodes o ON o.tree = p.tree AND o.level = n.level
                             AND o.slot = xor(p.slot >> n.level, 1)
            UNION ALL
            SELECT p.tree, p.slot, 1000 + u.level, o.node, (s.place >> u.level) % 2 = 1
            FROM placed p JOIN subroots s USING (tree)
            JOIN upper u ON u.slot = s.place >> u.level AND u.n > 1
            LEFT JOIN upper o ON o.level = u.level AND o.slot = xor(s.place >> u.level, 1)
        ), proofs AS (
            SELECT p.*, coalesce(s.siblings, []) AS siblings, coalesce(s.sides, []) AS sides,
                   sha256(coalesce(s.joined, '')) AS proof_sha256
            FROM placed p LEFT JOIN (
                SELECT tree, slot, list(coalesce(other, '') ORDER BY level) AS siblings,
                       list(after ORDER BY level) AS sides,
                       string_agg(coalesce(other, ''), '' ORDER BY level) AS joined
                FROM steps GROUP BY tree, slot
            ) s ON s.tree = p.tree AND s.slot = p.slot
        ), climbed AS (
            SELECT tree, slot, 0 AS step, shown AS node, siblings, sides FROM proofs
            UNION ALL
            SELECT tree, slot, step + 1,
                   CASE WHEN sides[step + 1] THEN sha256(siblings[step + 1] || node)
                        ELSE sha256(node || siblings[step + 1]) END, siblings, sides
            FROM climbed WHERE step < len(siblings)
        )
        SELECT p.doc_id, p.leaf, s.subroot, r.node AS root, p.proof_sha256,
               c.node AS folded_root, c.node = r.node AS verified
        FROM proofs p JOIN subroots s ON s.tree = p.tree
        JOIN climbed c ON c.tree = p.tree AND c.slot = p.slot AND c.step = len(p.siblings)
        CROSS JOIN (SELECT node FROM upper WHERE n = 1) r
    """,
}
