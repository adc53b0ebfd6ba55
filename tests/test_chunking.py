"""Chunking against plain loops, with small blocks so that one document spans many of them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ragloom.functions import scale
from ragloom.operators import chunking, elements

MAX = 300


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    result = []
    for doc, n in ((1, 400), (2, 12), (3, 1), (4, 2)):
        for i in range(n):
            text = "x" * int(rng.integers(1, 120) if i % 50 else 700)
            result.append((doc, i, text, [float(v) for v in rng.normal(size=4)], i // 3 + 1, "T" if i % 7 else "Title"))
    return result


@pytest.fixture(scope="module")
def prepared(spark, rows):
    frame = spark.createDataFrame(
        rows, "document_id long, pos int, text string, embedding array<float>, page int, element_type string"
    )
    for name in ("section_title", "table_html"):
        frame = frame.withColumn(name, F.lit(None).cast("string"))
    return scale.cut_lineage(elements.prepare_elements(frame))


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    for module in (chunking, elements):
        monkeypatch.setattr(module, "BLOCK_ROWS", 16)
    monkeypatch.setattr(
        chunking, "halo_blocks", lambda df, i, b, a, width=16, _f=scale.halo_blocks: _f(df, i, b, a, width=width)
    )


def _documents(rows):
    docs = {}
    for doc, _, text, vector, *_ in rows:
        docs.setdefault(doc, []).append((text, np.array(vector, dtype=np.float32).astype(float)))
    return docs


def _pack(texts, limit):
    done, open_, size = [], [], 0
    for text in texts:
        gap = 2 if open_ else 0
        if open_ and size + gap + len(text) > limit:
            done.append(open_)
            open_, size, gap = [], 0, 0
        open_ = [*open_, text]
        size += gap + len(text)
    return [*done, open_]


def test_semantic_chunks(prepared, rows):
    expected = []
    for doc, parts in _documents(rows).items():
        texts = [t for t, _ in parts]
        if len(texts) == 1:
            expected.append((doc, texts[0]))
            continue
        v = [x for _, x in parts]
        sims = [float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for a, b in zip(v, v[1:])]
        drops = [a - b for a, b in zip(sims, sims[1:])]
        breaks = [i + 2 for i, x in enumerate(drops) if x > np.percentile(drops, 95)] if drops else []
        for start, stop in zip([0, *breaks], [*breaks, len(texts)]):
            segment = texts[start:stop]
            groups = [segment] if sum(map(len, segment)) <= MAX else _pack(segment, MAX)
            expected += [(doc, "\n\n".join(g)) for g in groups if len("\n\n".join(g)) >= 100]
    found = chunking.chunk_semantic(prepared, MAX).select("document_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_title_chunks_bounds_and_overlap(prepared):
    chunks = chunking.chunk_by_title(prepared, MAX, 200, 50)
    assert chunks.filter(F.length("text") > MAX).isEmpty()
    whole = chunks.filter("document_id = 1").groupBy("seg", "part").agg(
        F.sum(F.length("text") - F.when(F.col("window") > 0, 50).otherwise(0)).alias("n")
    )
    lengths = prepared.filter("document_id = 1").agg(F.sum(F.length("text"))).first()[0]
    # Every character appears once outside the overlaps; only separators are added.
    assert 0 <= whole.agg(F.sum("n")).first()[0] - lengths <= 2 * 400


def test_sentence_chunks(prepared, rows):
    expected = []
    for doc, parts in _documents(rows).items():
        texts, v = [t for t, _ in parts], [x for _, x in parts]
        dist = [1 - float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) for a, b in zip(v, v[1:])]
        breaks = [i + 1 for i, x in enumerate(dist) if x > np.percentile(dist, 90)] if dist else []
        for start, stop in zip([0, *breaks], [*breaks, len(texts)]):
            text = " ".join(texts[start:stop])
            for i in range(0, len(text), MAX):
                piece = text[i : i + MAX].strip()
                if len(piece) >= 100:
                    expected.append((doc, piece))
    found = chunking.chunk_sentences(prepared, max_chars=MAX).select("document_id", "text").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_metadata_of_a_merged_chunk(prepared):
    breaks = prepared.filter("document_id = 2 AND idx = 6").select("document_id", "idx")
    chunk = chunking.assemble_chunks(prepared.filter("document_id = 2"), breaks, 5_000).filter("seg = 1").first()
    assert chunk["page_number"] == "3-4" and chunk["element_type"] == "merged" and chunk["first_idx"] == 6


def test_positions_and_ids(prepared):
    chunks = chunking.build_chunks(chunking.chunk_by_title(prepared, MAX, 200, 50)).collect()
    mine = sorted(c["pos"] for c in chunks if c["document_id"] == 1)
    assert mine == list(range(len(mine)))
    assert all(c["chunk_id"] == f"{c['document_id']}:{c['pos']}" for c in chunks)
    assert len({c["point_id"] for c in chunks}) == len(chunks)


def test_clean_and_tables(spark):
    frame = spark.createDataFrame(
        [
            (1, 0, "Prü­fungs-\nausschuss  \nEnde", "Text", None),
            (1, 1, "   ", "Text", None),
            (1, 2, "t", "Table", "<table><tr><td>a</td><td>b</td></tr><tr><td></td><td></td></tr></table>"),
            (1, 3, "t", "Table", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"),
        ],
        "document_id long, pos int, text string, element_type string, table_html string",
    ).withColumn("page", F.lit(1)).withColumn("section_title", F.lit(None).cast("string"))
    found = elements.prepare_elements(frame).orderBy("idx").collect()
    assert [r["text"] for r in found] == ["Prüfungsausschuss\nEnde", "a | b\n--- | ---\n1 | 2"]
    assert found[0]["roles"] == ["PRÜFUNGSAUSSCHUSS"] and [r["idx"] for r in found] == [0, 1]


@pytest.mark.parametrize("soft", [None, 20])
@pytest.mark.parametrize("limit", [9, 30])
def test_hot_segment_equals_one_pass(spark, soft, limit):
    """Segments far beyond a block, next to short ones, against a plain loop."""
    rng = np.random.default_rng(limit)
    rows, expected = [], {}
    for seg, (start, n) in enumerate([(0, 5), (5, 700), (705, 16), (721, 900)]):
        size, part = 0, -1
        for i in range(start, start + n):
            length = int(rng.integers(1, 8)) if i % 40 else 35
            if part < 0 or size + 2 + length > limit or (soft is not None and size > soft):
                size, part = length, part + 1
            else:
                size += 2 + length
            rows.append((7, seg, i, length))
            expected[i] = part
    frame = spark.createDataFrame(rows, "document_id long, seg long, idx long, length long")
    found = chunking.split_long_segments(frame, limit, soft).collect()
    assert {r["idx"]: r["part"] for r in found} == expected and len(found) == len(rows)


def test_roles_are_found_outside_a_lambda(spark):
    rows = spark.createDataFrame([("der Senat und das Dekanat",), (None,), ("x",)], "text string")
    tagged = elements.tag_roles(rows)
    assert [r["roles"] for r in tagged.collect()] == [["DEKANAT", "SENAT"], [], []]
    assert "lambda" not in tagged._jdf.queryExecution().optimizedPlan().toString()
    assert elements.tag_roles(rows, []).first()["roles"] == []


def test_short_segments_are_packed_without_blocks(spark, monkeypatch):
    def never(*_):
        raise AssertionError("no segment is longer than a block")

    monkeypatch.setattr(chunking, "_split_hot", never)
    rows = spark.range(30).select(
        F.lit(1).alias("document_id"), F.floor(F.col("id") / 10).alias("seg"), F.col("id").alias("idx"), F.lit(4).alias("length")
    )
    parts = {r["idx"]: r["part"] for r in chunking.split_long_segments(rows, 10).collect()}
    assert parts == {i: i % 10 // 2 for i in range(30)}
