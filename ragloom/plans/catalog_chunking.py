"""Chunking queries over the lines of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.functions.scale import cut_lineage
from ragloom.functions.text import clean
from ragloom.operators import chunking, chunks, elements
from ragloom.plans import datasets as data
from ragloom.plans.registry import query

MAX_CHARS = 600

LINES = """lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS text,
  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
els AS (SELECT document_id, pos, text, row_number() OVER (PARTITION BY document_id ORDER BY pos) - 1 AS idx,
  length(text) < 30 AS title, pos // 5 + 1 AS page FROM lines
  WHERE trim(text, ' ' || chr(9) || chr(13) || chr(160)) <> '')"""

SIMS = f"""{LINES}, vec AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
nxt AS MATERIALIZED (SELECT a.vec_id, list_dot_product(a.e, b.e)
  / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) AS s
  FROM vec a JOIN vec b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM vec)),
ev AS (SELECT document_id, idx, lead(idx) OVER (PARTITION BY document_id ORDER BY idx) AS follows, s
  FROM els JOIN nxt ON vec_id = (document_id + idx) % (SELECT count(*) FROM vec)),
sims AS (SELECT document_id, idx, s FROM ev WHERE follows IS NOT NULL)"""

BREAKS = f"""{SIMS}, drops AS (SELECT a.document_id, a.idx, a.s - b.s AS v FROM sims a
  JOIN sims b ON b.document_id = a.document_id AND b.idx = a.idx + 1),
lim AS (SELECT document_id, quantile_cont(v, 0.95) AS l FROM drops GROUP BY 1),
brk AS (SELECT document_id, idx + 2 AS idx FROM drops JOIN lim USING (document_id) WHERE v > l)"""


def _packed(separator: int, soft: str) -> str:
    """Greedy packing of `sized`(document_id, seg, idx, n, k), k counting from 1 inside a segment."""
    return f"""pack AS (SELECT document_id, seg, idx, k, n AS size, 0 AS part FROM sized WHERE k = 1
  UNION ALL SELECT s.document_id, s.seg, s.idx, s.k,
    CASE WHEN p.size + {separator} + s.n > {{limit}} OR {soft} THEN s.n ELSE p.size + {separator} + s.n END,
    CASE WHEN p.size + {separator} + s.n > {{limit}} OR {soft} THEN p.part + 1 ELSE p.part END
  FROM pack p JOIN sized s ON s.document_id = p.document_id AND s.seg = p.seg AND s.k = p.k + 1)"""


_SEGMENTED = """seged AS (SELECT e.*, sum(CASE WHEN b.idx IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY e.document_id
  ORDER BY e.idx)::BIGINT AS seg FROM els e LEFT JOIN brk b USING (document_id, idx)),
sized AS (SELECT document_id, seg, idx, length(text) AS n, row_number() OVER (PARTITION BY document_id, seg ORDER BY idx) AS k
  FROM seged)"""

_SEMANTIC = f"""{BREAKS}, {_SEGMENTED}, {_packed(2, 'FALSE').format(limit=MAX_CHARS)},
tot AS (SELECT document_id, seg, sum(n) AS total FROM sized GROUP BY ALL),
parts AS (SELECT g.*, CASE WHEN total > {MAX_CHARS} THEN part ELSE 0 END AS part FROM seged g JOIN tot USING (document_id, seg)
  JOIN pack USING (document_id, seg, idx)),
joined AS (SELECT document_id, seg, part, min(idx) AS first_idx, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text,
  min(page) AS p1, max(page) AS p2, bool_or(title) AS t1, bool_and(title) AS t2,
  arg_min(text, idx) FILTER (title) AS section_title FROM parts GROUP BY ALL),
final AS (SELECT * FROM joined WHERE length(text) >= 100 OR document_id IN (SELECT document_id FROM els GROUP BY 1
  HAVING count(*) = 1))"""


def _prepared(spark, d) -> DataFrame:
    return data.stored(spark, d, "prepared", lambda: elements.prepare_elements(data.elements(spark, d)))


def _embedded(spark, d) -> DataFrame:
    return data.stored(spark, d, "embedded", lambda: data.with_embeddings(_prepared(spark, d), spark, d))


@query(
    "clean_elements",
    """WITH raw AS (SELECT doc_id, replace(replace(text, 'en', 'e' || chr(173) || 'n'), ' the ', '-' || chr(10) || 'the ' || chr(9)
  || chr(10)) AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(replace(t, chr(173), ''), '-\\n([\\p{L}\\p{M}\\p{Nd}_])', '\\1', 'g'),
  '[ \\t]+\\n', chr(10), 'g')) AS text FROM raw""",
)
def clean_elements(spark, d) -> DataFrame:
    raw = F.replace(F.col("text"), F.lit("en"), F.lit("e­n"))
    raw = F.replace(raw, F.lit(" the "), F.lit("-\nthe \t\n"))
    return data.table(spark, d, "documents").select("doc_id", F.md5(clean(raw)).alias("text"))


@query(
    "tag_roles",
    f"""WITH {LINES}, up AS (SELECT document_id, idx, upper(text) AS u FROM els)
SELECT document_id, idx, concat_ws(',', CASE WHEN contains(u, 'THE') THEN 'THE' END, CASE WHEN contains(u, 'ÜNG') THEN 'ÜNG' END,
  CASE WHEN contains(u, 'PRA') THEN 'PRA' END) AS roles FROM up""",
)
def tag_roles(spark, d) -> DataFrame:
    tagged = elements.tag_roles(_prepared(spark, d).drop("roles"), ["THE", "ÜNG", "PRA"])
    return tagged.select("document_id", "idx", F.array_join("roles", ",").alias("roles"))


def _tables(spark, d) -> DataFrame:
    """A small HTML table per conversation turn, of one of five kinds by turn."""
    role, n = F.col("role"), F.col("turn").cast("string")
    cell = lambda text, tag="td": F.concat(F.lit(f"<{tag} class='x'> "), text, F.lit(f" </{tag}>"))
    row = lambda *cells: F.concat(F.lit("<tr>"), *cells, F.lit("</tr>"))
    empty = F.lit("<td>&nbsp;</td>")
    plain = F.concat(
        F.lit("<TABLE>"), row(cell(F.lit("a &amp; b"), "th"), cell(F.lit("<b>c</b>"), "th")), row(empty, empty),
        row(cell(role), cell(n)), row(cell(F.lit("z")), cell(F.lit("y"))), row(cell(F.lit("q")), cell(F.lit("p"))),
        F.lit("</TABLE>"),
    )
    kinds = F.array(
        plain,
        F.concat(F.lit("<table>"), row(cell(role), empty), row(empty, cell(n)), F.lit("</table>")),
        F.concat(F.lit("<table>"), row(cell(F.lit("☐ yes")), cell(role)), F.lit("</table>")),
        F.concat(F.lit("<table>"), row(cell(F.lit("Name:")), cell(role)), row(cell(F.lit("Date*")), cell(n)),
                 row(cell(F.lit("x")), cell(n)), F.lit("</table>")),
        F.concat(F.lit("<table>"), row(cell(role), cell(n)), F.lit("</table>")),
        F.lit("<p>no table</p>"),
    )
    return data.turns(spark, d).select("conv_id", "turn", kinds[(F.col("turn") % 6).cast("int")].alias("html"))


@query(
    "classify_tables",
    "SELECT conv_id, turn, turn % 6 IN (1, 2, 3) AS is_form FROM conversations",
)
def classify_tables(spark, d) -> DataFrame:
    return elements.classify_tables(_tables(spark, d)).select("conv_id", "turn", "is_form")


@query(
    "tables_to_text",
    """SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 'a & b | c' || chr(10) || '--- | ---' || chr(10) || role || ' | ' || turn
  || chr(10) || 'z | y' || chr(10) || 'q | p' WHEN 4 THEN role || ' | ' || turn ELSE '' END AS table_text FROM conversations""",
)
def tables_to_text(spark, d) -> DataFrame:
    return elements.tables_to_text(_tables(spark, d)).select("conv_id", "turn", "table_text")


@query(
    "adjacent_similarity",
    f"WITH {SIMS} SELECT document_id, idx, round(s, 6) AS similarity FROM sims",
)
def adjacent_similarity(spark, d) -> DataFrame:
    rows = chunking.adjacent_similarity(_embedded(spark, d))
    return rows.withColumn("similarity", F.round("similarity", 6))


@query(
    "semantic_breakpoints",
    f"WITH {BREAKS} SELECT document_id, idx FROM brk",
)
def semantic_breakpoints(spark, d) -> DataFrame:
    return chunking.semantic_breakpoints(chunking.adjacent_similarity(_embedded(spark, d)))


@query(
    "chunk_semantic",
    f"""WITH RECURSIVE {_SEMANTIC} SELECT document_id, seg, part::BIGINT AS part, first_idx, md5(text) AS text,
  CASE WHEN p1 = p2 THEN p1::VARCHAR ELSE p1 || '-' || p2 END AS page_number, md5(section_title) AS section_title,
  CASE WHEN t2 THEN 'Title' WHEN t1 THEN 'merged' ELSE 'NarrativeText' END AS element_type FROM final""",
)
def chunk_semantic(spark, d) -> DataFrame:
    rows = chunking.chunk_semantic(_embedded(spark, d), MAX_CHARS)
    return rows.select(
        "document_id", "seg", "part", "first_idx", F.md5("text").alias("text"), "page_number",
        F.md5("section_title").alias("section_title"), "element_type",
    )


@query(
    "split_long_segments",
    f"""WITH RECURSIVE {LINES}, brk AS (SELECT document_id, idx FROM els WHERE idx > 0 AND idx % 20 = 0), {_SEGMENTED},
{_packed(2, 'FALSE').format(limit=400)} SELECT document_id, seg, idx, part::BIGINT AS part FROM pack""",
)
def split_long_segments(spark, d) -> DataFrame:
    prepared = _prepared(spark, d)
    breaks = prepared.filter((F.col("idx") > 0) & (F.col("idx") % 20 == 0)).select("document_id", "idx")
    return chunking.split_long_segments(cut_lineage(chunking.segments(prepared, breaks)), 400)


_TITLED = f"""{LINES}, brk AS (SELECT document_id, idx FROM els WHERE title), {_SEGMENTED},
{_packed(2, 'p.size > 300').format(limit=500)},
joined AS (SELECT document_id, seg, part, min(idx) AS first_idx, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text
  FROM seged JOIN pack USING (document_id, seg, idx) GROUP BY ALL),
cut AS (SELECT document_id, seg, part, first_idx, w AS "window", substr(text, 1 + w * 420, 500) AS text FROM joined,
  range(1000) r(w) WHERE w = 0 OR w < ceil((length(text) - 80) / 420.0)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY first_idx, "window") - 1 AS pos FROM cut)"""


def _titled(spark, d) -> DataFrame:
    return chunking.chunk_by_title(_prepared(spark, d), 500, 300, 80)


@query(
    "chunk_by_title",
    f"""WITH RECURSIVE {_TITLED} SELECT document_id, seg, part::BIGINT AS part, "window", md5(text) AS text FROM cut""",
)
def chunk_by_title(spark, d) -> DataFrame:
    return _titled(spark, d).select(
        "document_id", "seg", "part", F.col("window").cast("long").alias("window"), F.md5("text").alias("text")
    )


@query(
    "build_chunks",
    f"""WITH RECURSIVE {_TITLED}, ids AS (SELECT n.*, n.document_id || ':' || pos AS chunk_id FROM numbered n),
h AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(chunk_id)) AS x FROM ids)
SELECT chunk_id, pos, md5(text) AS text, CASE WHEN document_id % 2 = 0 THEN 'src' || document_id % 3 END AS process_name,
  substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-'
  || substr('89ab', 1 + (('0x' || substr(x, 17, 1))::INT & 3), 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS point_id
FROM h""",
)
def build_chunks(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    process = F.when(doc % 2 == 0, F.concat(F.lit("src"), (doc % 3).cast("string"))).otherwise("")
    meta = data.table(spark, d, "documents").select(
        doc.alias("document_id"), process.alias("process_name"), F.lit("").alias("tags"),
        F.lit("f").alias("file_name"),
    )
    rows = chunking.build_chunks(_titled(spark, d), meta)
    return rows.select(
        "chunk_id", F.col("pos").cast("long").alias("pos"), F.md5("text").alias("text"), "process_name", "point_id"
    )


@query(
    "chunk_sentences",
    f"""WITH {SIMS}, dist AS (SELECT document_id, idx, 1 - s AS v FROM sims),
lim AS (SELECT document_id, quantile_cont(v, 0.9) AS l FROM dist GROUP BY 1),
brk AS (SELECT document_id, idx + 1 AS idx FROM dist JOIN lim USING (document_id) WHERE v > l),
seged AS (SELECT e.document_id, e.idx, trim(e.text, ' ' || chr(9) || chr(13) || chr(160)) AS text, sum(CASE WHEN b.idx IS NULL THEN 0 ELSE 1 END)
  OVER (PARTITION BY e.document_id ORDER BY e.idx)::BIGINT AS seg FROM els e LEFT JOIN brk b USING (document_id, idx)),
joined AS (SELECT document_id, seg, string_agg(text, ' ' ORDER BY idx) AS text FROM seged GROUP BY ALL),
cut AS (SELECT document_id, seg, p AS part, trim(substr(text, 1 + p * 500, 500)) AS text FROM joined, range(1000) r(p)
  WHERE p * 500 < length(text))
SELECT document_id, seg, part, md5(text) AS text FROM cut WHERE length(text) >= 100""",
)
def chunk_sentences(spark, d) -> DataFrame:
    rows = chunking.chunk_sentences(_embedded(spark, d), max_chars=500)
    return rows.select("document_id", "seg", "part", F.md5("text").alias("text"))


# ---- the chunk table -----------------------------------------------------------------------------------------------


@query(
    "index_manual",
    """WITH e AS (SELECT doc_id % 700 AS k, arg_max(lang, doc_id) AS lang FROM documents GROUP BY 1)
SELECT d.doc_id::VARCHAR || ':0' AS chunk_id, CASE WHEN e.k IS NULL THEN md5(d.text) ELSE md5('manual ' || e.lang) END AS text,
  CASE WHEN e.k IS NULL THEN d.source END AS process_name FROM documents d LEFT JOIN e ON e.k = d.doc_id""",
)
def index_manual(spark, d) -> DataFrame:
    doc = F.col("doc_id")
    entries = data.table(spark, d, "documents").select(
        (doc % 700).cast("string").alias("document_id"), F.concat(F.lit("manual "), F.col("lang")).alias("text"),
        F.lit("").alias("process_name"), F.lit(None).cast("string").alias("tags"), doc.alias("n"),
    )
    rows = chunks.index_manual(data.chunks(spark, d), entries, F.col("n"))
    return rows.select("chunk_id", F.md5("text").alias("text"), "process_name")


@query(
    "delete_chunks",
    """SELECT 'process' AS by, count(*) FILTER (source = 'src7') AS deleted, count(*) FILTER (source <> 'src7') AS kept FROM documents
UNION ALL SELECT 'tag', count(*) FILTER (lang = 'de'), count(*) FILTER (lang <> 'de') FROM documents
UNION ALL SELECT 'all', count(*), 0 FROM documents""",
)
def delete_chunks(spark, d) -> DataFrame:
    rows = data.chunks(spark, d)
    result = None
    for name, options in (("process", {"process": "src7"}), ("tag", {"tag": "de"}), ("all", {})):
        kept, deleted = chunks.delete_chunks(rows, **options)
        one = deleted.select(F.lit(name).alias("by"), "deleted").join(
            kept.agg(F.count(F.lit(1)).alias("kept")).withColumn("by", F.lit(name)), "by"
        )
        result = one if result is None else result.unionByName(one)
    return result


_BLANKED = "CASE WHEN doc_id % 9 = 0 THEN ' ' || chr(10) ELSE text END"


def _old_chunks(spark, d) -> DataFrame:
    doc = F.col("document_id").cast("long")
    return data.chunks(spark, d).withColumn(
        "text", F.when(doc % 9 == 0, " \n").otherwise(F.col("text"))
    ).withColumn(
        "tags", F.when(doc % 4 == 0, F.array(F.col("tags"), F.lit(""), F.lit("x"))).when(doc % 4 == 1, F.array(F.lit("")))
        .otherwise(F.array("tags"))
    ).withColumn("page_number", (doc % 10).cast("int"))


@query(
    "reindex",
    f"""SELECT doc_id::VARCHAR || ':0' AS chunk_id, md5(text) AS text, (doc_id % 10)::VARCHAR AS page_number,
  CASE doc_id % 4 WHEN 0 THEN lang || ',x' WHEN 1 THEN NULL ELSE lang END AS tags, label::BIGINT AS label
FROM documents JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) WHERE trim({_BLANKED}, ' ' || chr(10) || chr(9) || chr(13)) <> ''""",
)
def reindex(spark, d) -> DataFrame:
    vectors = data.chunk_vectors(spark, d)
    rows = chunks.reindex(_old_chunks(spark, d), vectors)[0].join(vectors.select("chunk_id", "label"), "chunk_id")
    return rows.select(
        "chunk_id", F.md5("text").alias("text"), "page_number", "tags", F.col("label").cast("long").alias("label")
    )


@query(
    "reindex_counts",
    f"""SELECT count(*) FILTER (NOT b AND v) AS processed, count(*) FILTER (b) AS skipped,
  count(*) FILTER (NOT b AND NOT v) AS unvectored FROM (
  SELECT trim({_BLANKED}, ' ' || chr(10) || chr(9) || chr(13)) = '' AS b, doc_id IN (SELECT vec_id FROM embeddings) AS v
  FROM documents)""",
)
def reindex_counts(spark, d) -> DataFrame:
    vectors = data.vectors(spark, d).withColumn("chunk_id", F.concat(F.col("chunk_id").cast("string"), F.lit(":0")))
    return chunks.reindex(_old_chunks(spark, d), vectors)[1]


@query(
    "process_names",
    """SELECT source AS name, count(*) AS doc_count, FALSE AS has_model FROM documents GROUP BY 1
ORDER BY doc_count DESC, name LIMIT 12""",
)
def process_names(spark, d) -> DataFrame:
    return chunks.process_names(data.chunks(spark, d), 12)
