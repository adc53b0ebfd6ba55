"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ragloom.llm import (
    collocations,
    exact_dedup,
    hard_negatives,
    html_extraction,
    language_id,
    license_scan,
    mixing,
    ngram_join,
    personal_data,
    sentencepiece_codec,
    suffix_dedup,
    topk_search,
    warc,
)


def _table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def op1_warc(spark: SparkSession, directory: str) -> DataFrame:
    read = warc.round_trip(_table(spark, directory, "pages"))
    return read.select(
        "page_id", F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", "refers_to", "digest_ok"
    )


def op2_ngram_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, directory, "documents"), words=3, percent=90).select(
        "doc_id", "n_shingles", "component_id"
    )


def op3_license_scan(spark: SparkSession, directory: str) -> DataFrame:
    return license_scan.scan(_table(spark, directory, "documents"))


def op4_language_id(spark: SparkSession, directory: str) -> DataFrame:
    documents = _table(spark, directory, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 4 == 2
    model = language_id.train(documents.filter(~held_out & F.col("lang").isNotNull()))
    return language_id.predict(documents.withColumn("held_out", held_out), model, keep=["doc_id", "held_out"])


def op5_source_mixing(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(_table(spark, directory, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op6_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, directory, "documents"))


def op7_exact_topk(spark: SparkSession, directory: str) -> DataFrame:
    return topk_search.top_k(_table(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    documents = _table(spark, directory, "documents")
    pieces = sentencepiece_codec.load_pieces(sentencepiece_codec.DEFAULT_MODEL)
    coded = sentencepiece_codec.round_trip(documents.select("doc_id", "text"), pieces)
    return coded.select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "n_bytes", "decoded_sha256", "lossless"
    )


def op9_html_text(spark: SparkSession, directory: str) -> DataFrame:
    return html_extraction.extract(_table(spark, directory, "pages"))


def op10_suffix_dedup(spark: SparkSession, directory: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, directory, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"
    )


def op11_pii(spark: SparkSession, directory: str) -> DataFrame:
    return personal_data.find(_table(spark, directory, "documents"), keep=["doc_id"])


def op12_collocations(spark: SparkSession, directory: str) -> DataFrame:
    return collocations.mine(_table(spark, directory, "documents"))


def op13_hard_negatives(spark: SparkSession, directory: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, directory, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_ngram_jaccard, op3_license_scan, op4_language_id, op5_source_mixing, op6_exact_dedup,
        op7_exact_topk, op8_sentencepiece, op9_html_text, op10_suffix_dedup, op11_pii, op12_collocations,
        op13_hard_negatives,
    )
}

ORACLES = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
        ), g AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS best FROM d
        )
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM best THEN best END AS refers_to, true AS digest_ok
        FROM g
    """,
    "op5_source_mixing": """
        WITH sized AS (
            SELECT doc_id, source, md5(coalesce(text, '')) AS mark, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
            FROM documents
        ), hashed AS (
            SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || mark), 1, 12))::BIGINT AS h
            FROM sized
        ), s AS (
            SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
        ), w AS (
            SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM s
        ), o AS (
            SELECT *, row_number() OVER (ORDER BY source_size * 3 / weight, source ASC NULLS LAST) AS place FROM w
        ), l AS (
            SELECT *, (sum(source_size) OVER ()
                - coalesce(sum(source_size * 3) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM o
        ), t AS (
            SELECT source, source_size, least((source_size * 3)::DOUBLE, weight
                * (SELECT arg_min(level, place) FROM l WHERE level * weight <= source_size * 3)) AS target
            FROM l
        ), b AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t
        ), c AS (
            SELECT h.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS remaining,
                sum(h.size) OVER (PARTITION BY h.source, h.h) AS step,
                sum(h.size) OVER (PARTITION BY h.source ORDER BY h.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                    AS upto
            FROM hashed h JOIN b ON h.source IS NOT DISTINCT FROM b.source
        ), f AS (
            SELECT *, min(CASE WHEN upto > remaining THEN h END) OVER (PARTITION BY source) AS cut FROM c
        )
        SELECT doc_id, size, source_size, target, source, (size * least(3, whole + CASE
            WHEN cut IS NULL OR h < cut THEN 1
            WHEN h = cut AND upto - remaining < remaining - (upto - step) THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM f
    """,
    "op6_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
        g AS (
            SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
        ), n AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, text_sha256) AS copy FROM d
        )
        SELECT n.doc_id, keep_id, group_size, n.doc_id IS NOT DISTINCT FROM keep_id AND copy = 1 AS kept, text_sha256
        FROM n JOIN g USING (text_sha256)
    """,
    "op7_exact_topk": """
        WITH v AS (
            SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_collocations": """
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
            FROM documents
        ), lists AS (
            SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
        ), totals AS (
            SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang
        ), occurrences AS (
            SELECT lang, k, unnest([array_to_string(w[i : i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
            FROM lists, range(1, 6) AS sizes(k)
        ), f AS (
            SELECT lang, k, phrase, count(*)::BIGINT AS a FROM occurrences GROUP BY ALL
        ), c AS (
            SELECT * FROM f WHERE k >= 2 AND a >= 100
        ), kept AS (
            SELECT * FROM c WHERE NOT EXISTS (
                SELECT 1 FROM c AS q WHERE q.lang = c.lang AND q.k > c.k AND 100 * q.a >= 100 * c.a
                    AND contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))
        ), cuts AS (
            SELECT lang, phrase, a, cut, array_to_string(string_split(phrase, ' ')[:cut], ' ') AS head,
                array_to_string(string_split(phrase, ' ')[cut + 1 :], ' ') AS tail
            FROM kept, range(1, 5) AS places(cut) WHERE cut < k
        ), scored AS (
            SELECT cuts.lang, cuts.phrase, cuts.a, cut, h.a AS l, t.a AS r, n,
                ((1000::HUGEINT * cuts.a * n) // (h.a::HUGEINT * t.a))::BIGINT AS score
            FROM cuts JOIN f AS h ON h.lang = cuts.lang AND h.phrase = head
            JOIN f AS t ON t.lang = cuts.lang AND t.phrase = tail JOIN totals ON totals.lang = cuts.lang
        ), best AS (
            SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS place FROM scored
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
            FROM best WHERE place = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                [floor(256 * x::DOUBLE) FOR x IN embedding] AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND label IS NOT NULL
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), s AS (
            SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.x, c.x)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
            FROM s WHERE same
        ), n AS (
            SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
            FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND place <= 5
                AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score
        )
        SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM n WHERE rank <= 5
    """,
}
