"""Search, fusion and reranking on small literals, and the paths taken by large query tables."""

import math
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.operators import dense, fusion, lexical, similarity_join


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["alpha beta beta", "alpha gamma", "beta gamma delta", "delta", "alpha beta beta", ""]
    return spark.createDataFrame(
        [(f"d{i}", t, "p1" if i % 2 else "p2", "t1") for i, t in enumerate(texts)],
        "chunk_id string, text string, process_name string, tags string",
    )


def test_bm25_by_hand(spark, corpus):
    queries = spark.createDataFrame([(1, "Beta, beta delta!")], "query_pk long, text string")
    hits = {r["chunk_id"]: r for r in lexical.bm25_topk(queries, lexical.postings(corpus), 10).collect()}
    n, mean = 6, (3 + 2 + 3 + 1 + 3 + 0) / 6
    idf = lambda df: np.log(1 + (n - df + 0.5) / (df + 0.5))
    part = lambda tf, dl, df: idf(df) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))
    assert hits["d0"]["score"] == pytest.approx(3 * 2 * part(2, 3, 3), abs=1e-8)
    assert hits["d2"]["score"] == pytest.approx(3 * (2 * part(1, 3, 3) + part(1, 3, 2)), abs=1e-8)
    # Equal copies tie and follow their ids.
    assert hits["d0"]["score"] == hits["d4"]["score"] and hits["d0"]["rank"] < hits["d4"]["rank"]
    assert set(hits) == {"d0", "d2", "d3", "d4"}


def test_bm25_without_broadcast_gives_the_same(spark, corpus, monkeypatch):
    queries = spark.createDataFrame([(1, "beta delta"), (2, "alpha"), (3, "p1")], "query_pk long, text string")
    small = lexical.bm25_topk(queries, lexical.postings(corpus), 3)
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(lexical, "SLICE_TERMS", 1)
    large = lexical.bm25_topk(queries, lexical.postings(corpus), 3)
    assert small.exceptAll(large).isEmpty() and small.count() == large.count()


def test_stored_index(spark, corpus, tmp_path):
    queries = spark.createDataFrame([(1, "beta delta")], "query_pk long, text string")
    lexical.write_index(corpus, str(tmp_path))
    stored = lexical.bm25_topk(queries, lexical.read_index(spark, str(tmp_path)), 5)
    assert stored.exceptAll(lexical.bm25_topk(queries, lexical.postings(corpus), 5)).isEmpty()


def test_blocks_below_the_threshold_are_not_read(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_CHUNKS", 10)
    monkeypatch.setattr(lexical, "SHELF_BLOCKS", 4)
    rng = np.random.default_rng(8)
    rows = []
    for n in range(800):  # stored by topic, with a common word everywhere
        topic = n // 100
        words = [f"t{topic}w{int(w)}" for w in rng.integers(0, 30, int(rng.integers(5, 40)))] + ["common"] * int(rng.integers(0, 3))
        rows.append((f"d{n:04d}", " ".join(words), "p", "t"))
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, process_name string, tags string").coalesce(1)
    queries = spark.createDataFrame([(1, "common t3w1 t3w2"), (2, "t5w7 t5w8 t5w9 common")], "query_pk long, text string")
    index = lexical.write_index(chunks.sort("chunk_id").coalesce(1), lexical.work_path(spark))
    seen = spark.sparkContext.accumulator(0)
    scores = lexical.Asked.scores

    def counting(self, batch, n, wanted):
        seen.add(int(wanted.sum()))
        return scores(self, batch, n, wanted)

    monkeypatch.setattr(lexical.Asked, "scores", counting)
    hits = {(r["query_pk"], r["chunk_id"]): r["score"] for r in lexical.bm25_topk(queries, index, 3).collect()}
    lengths = {c: len(t.split()) for c, t, _, _ in rows}
    mean, df = sum(lengths.values()) / 800, {}
    for _, t, _, _ in rows:
        for w in set(t.split()):
            df[w] = df.get(w, 0) + 1
    for q, text in ((1, "common t3w1 t3w2"), (2, "t5w7 t5w8 t5w9 common")):
        scores = {}
        for c, t, _, _ in rows:
            words = t.split()
            s = sum(
                np.log(1 + (800 - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * 2.2
                / (words.count(w) + 1.2 * (0.25 + 0.75 * lengths[c] / mean)) for w in text.split() if w in words
            )
            scores[c] = round(3 * s, 9)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:3]
        assert {c for (n, c) in hits if n == q} == {c for c, _ in best}
        assert all(hits[q, c] == pytest.approx(s, abs=1e-8) for c, s in best)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(300, 8)).round(2)
    data[100:200] = data[0]  # a third of all rows are copies
    rows = [(f"c{i:03d}", [float(x) for x in v], f"p{i % 3}", f"t{i % 2}") for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "chunk_id string, embedding array<float>, process_name string, tags string")


def _brute(vectors, queries, k):
    corpus = vectors.toPandas()
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    c = unit(np.stack(corpus.embedding).astype(float))
    result = set()
    for q in queries.collect():
        sims = np.round(c @ unit(np.array([q["embedding"]], dtype=float))[0], 9)
        keep = np.ones(len(corpus), bool)
        if q["filter_process"]:
            keep &= (corpus.process_name == q["filter_process"]).values
        if q["filter_tags"]:
            keep &= corpus.tags.isin(q["filter_tags"]).values
        order = [i for i in np.lexsort((corpus.chunk_id, -sims)) if keep[i]][:k]
        result |= {(q["query_pk"], corpus.chunk_id[i], rank) for rank, i in enumerate(order, 1)}
    return result


@pytest.mark.parametrize("large", [False, True])
def test_vector_search_against_brute_force(spark, vectors, monkeypatch, large):
    queries = vectors.filter("chunk_id < 'c012'").select(
        F.substring("chunk_id", 2, 3).cast("long").alias("query_pk"), "embedding"
    ).withColumn("filter_process", F.when(F.col("query_pk") % 4 == 1, "p1")).withColumn(
        "filter_tags", F.when(F.col("query_pk") % 4 == 2, F.array(F.lit("t1")))
    )
    if large:
        monkeypatch.setattr(dense, "SLICE_QUERIES", 3)
    hits = dense.vector_topk(queries, vectors, 20).collect()
    assert {(r["query_pk"], r["chunk_id"], r["rank"]) for r in hits} == _brute(vectors, queries, 20)
    # A filter on a column that isn't there filters nothing, however many slices there are.
    plain = dense.vector_topk(queries, vectors.drop("process_name", "tags"), 5)
    free = dense.vector_topk(queries.drop("filter_process", "filter_tags"), vectors, 5)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, free.collect()))
    only_tags = dense.vector_topk(queries, vectors.drop("process_name"), 5)
    tagged = dense.vector_topk(queries.drop("filter_process"), vectors, 5)
    assert sorted(map(tuple, only_tags.collect())) == sorted(map(tuple, tagged.collect()))


def test_similar_pairs_against_brute_force(vectors):
    pairs = similarity_join.similar_pairs(vectors, "chunk_id", 0.8, rows=50).collect()
    data = vectors.toPandas()
    m = np.stack(data.embedding).astype(float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = np.round(m @ m.T, 9)
    expected = {(data.chunk_id[i], data.chunk_id[j]) for i in range(300) for j in range(i + 1, 300) if s[i, j] >= 0.8}
    assert {(r["a"], r["b"]) for r in pairs} == expected
    assert len(pairs) == len(expected)


def _clustered(rng, spark):
    """30 narrow clusters, a third of all rows copies of one vector, a zero, a null and a non-finite vector."""
    centres = rng.normal(size=(30, 16))
    rows = [centres[i % 30] + rng.normal(size=16) * 0.08 for i in range(600)] + [centres[0] + 0.01] * 300
    table = [(i, [float(x) for x in v]) for i, v in enumerate(rows)]
    table += [(900, [0.0] * 16), (901, None), (902, [float("nan")] * 16), (None, table[0][1])]
    return spark.createDataFrame(table, "node_id long, embedding array<double>"), np.array(rows)


@pytest.mark.parametrize("threshold, slab", [(0.9, 512), (0.97, 2), (1.0, 512), (-0.2, 3)])
def test_blocks_meet_only_where_pivots_allow(spark, monkeypatch, threshold, slab):
    monkeypatch.setattr(similarity_join, "SLAB_BLOCKS", slab)
    table, m = _clustered(np.random.default_rng(3), spark)
    if threshold <= 0:
        m = np.vstack([m, np.zeros(16)])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    unit = np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)
    s = np.round(unit @ unit.T, 9)
    x, y = np.nonzero(np.triu(s >= threshold, 1))
    rows = similarity_join.similar_pairs(table, "node_id", threshold, rows=20).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == sorted(zip(x.tolist(), y.tolist()))
    assert all(r["similarity"] == pytest.approx(s[r["a"], r["b"]], abs=1e-8) for r in rows)
    blocks, pairs = similarity_join.block_pairs(table, "node_id", threshold, rows=20)
    sizes = {r["block"]: len(r["ids"]) for r in blocks.select("block", "ids").collect()}
    assert sum(sizes.values()) == len(m) and max(sizes.values()) <= 60
    met = [tuple(r) for r in pairs.collect()]
    assert len(set(met)) == len(met) and all(a <= b for a, b in met)
    tested = sum(sizes[a] * (sizes[a] - 1) / 2 if a == b else sizes[a] * sizes[b] for a, b in met)
    if threshold >= 0.9:
        # The copies alone are a ninth of all pairs.
        assert tested < 0.3 * len(m) * (len(m) - 1) / 2


def test_blocks_that_all_meet_are_sent_once_per_band(spark):
    number = spark.range(200)
    pairs = number.select(F.col("id").alias("left_block")).join(number.select(F.col("id").alias("block")), F.col("left_block") <= F.col("block"))
    sides, bands = similarity_join.banded(pairs, 200)
    rows = sides.collect()
    assert len(rows) <= 200 * bands < 2 * 20_100 / 10
    place = {(r["low"], r["high"], r["block"]) for r in rows}
    met = sorted((r["block"], p) for r in rows for p in r["partners"] if (r["low"], r["high"], p) in place)
    assert met == [(i, j) for i in range(200) for j in range(i, 200)]


def test_similar_copies_come_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(similarity_join, "TILE_ROWS", 7)
    monkeypatch.setattr(similarity_join, "TILE_COLUMNS", 11)
    table = spark.range(60).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    found = similarity_join.similar_pairs(table, "id", 0.9, rows=25).collect()
    assert sorted((r["a"], r["b"]) for r in found) == [(i, j) for i in range(60) for j in range(i + 1, 60)]


def test_similar_pairs_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, [0.0, 0.0])], [(1, [1.0, 0.0]), (1, [1.0, 0.0])]):
        table = spark.createDataFrame(rows, "node_id long, embedding array<double>")
        assert similarity_join.similar_pairs(table, "node_id", 0.5).isEmpty()


def test_fusion_ties(spark):
    ranked = "query_pk long, chunk_id string, rank int"
    text = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], ranked)
    near = spark.createDataFrame([(1, "d", 1), (1, "e", 2), (1, "b", 4)], ranked)
    rows = fusion.fuse(text, near).orderBy(*fusion.fused_order()).collect()
    # b is on both lists; a and d tie at 1/61, c and nothing else at 1/63: text hits come first.
    assert [r["chunk_id"] for r in rows] == ["b", "a", "d", "e", "c"]
    assert rows[0]["score"] == pytest.approx(1 / 62 + 1 / 64)


def test_rrf_zero_means_default(spark):
    ranked = spark.createDataFrame([(1,)], "rank int")
    assert fusion.rrf(ranked, 0).first()["weight"] == pytest.approx(1 / 61)


def test_hydrate_drops_unknown_and_closes_ranks(spark, corpus):
    hits = spark.createDataFrame([(1, "zz", 1), (1, "d1", 2), (1, "d0", 3)], "query_pk long, chunk_id string, rank int")
    chunks = corpus.withColumn("section_title", F.lit("S")).withColumn("title", F.lit(""))
    rows = {r["chunk_id"]: r for r in fusion.hydrate(hits, chunks).collect()}
    assert {k: r["rank"] for k, r in rows.items()} == {"d1": 1, "d0": 2}
    assert rows["d1"]["title"] == "S"


def test_rerank_modes(spark):
    hits = spark.createDataFrame(
        [(q, c, r, "rrf") for q in (1, 2, 3) for r, c in enumerate("abc", 1)],
        "query_pk long, chunk_id string, rank int, source string",
    )
    queries = spark.createDataFrame([(1, "x"), (2, "y"), (3, "  ")], "query_pk long, text string")
    scores = spark.createDataFrame(
        [(1, "a", 0.1), (1, "b", 0.9), (1, "c", 0.9), (3, "c", 1.0)], "query_pk long, chunk_id string, pair_score double"
    )
    rows = {(r["query_pk"], r["rank"]): r for r in fusion.rerank(hits, queries, scores, 2).collect()}
    assert [rows[1, i]["chunk_id"] for i in (1, 2)] == ["b", "c"] and rows[1, 1]["source"] == "ce"
    assert [rows[2, i]["rerank_score"] for i in (1, 2)] == pytest.approx([1.0, 0.9]) and rows[2, 1]["source"] == "rrf"
    assert rows[3, 1]["chunk_id"] == "a" and rows[3, 1]["rerank_score"] is None
    assert len(rows) == 6


def test_confidence_levels(spark):
    hits = spark.createDataFrame(
        [(1, 2.0, None), (1, -5.0, None), (2, None, 1.7), (3, None, -0.2), (4, None, None)],
        "query_pk long, rerank_score double, score double",
    )
    rows = {r["query_pk"]: (r["confidence"], r["level"]) for r in fusion.answer_confidence(hits).collect()}
    assert rows[1] == (pytest.approx(1 / (1 + np.exp(-2.0))), "high")
    assert rows[2] == (1.0, "high") and rows[3] == (0.0, "low") and rows[4] == (None, "low")


def test_a_task_leaves_out_blocks_below_what_a_filtered_query_has_found(monkeypatch):
    monkeypatch.setattr("pyspark.TaskContext.get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    words = [["alpha"] * 3 + ["beta"]] * 64 + [["alpha"] + ["filler"] * (20 + n % 9) for n in range(256)] + [[]] * 64
    columns = [[f"c{n:03}" for n in range(384)], [f"p{n % 20}" for n in range(384)], ["en"] * 384]
    given = pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(words, pa.list_(pa.string()))], list("abcd"))
    blocks = list(lexical._counted(iter([given])))
    assert len(blocks) == 6
    asked = lexical.Asked(pd.DataFrame({
        "query_pk": [7, 7, 9], "term": ["alpha", "beta", "filler"], "qtf": [1, 2, 1], "_process": ["p3", "p3", None],
        "_tags": [None, ["en"], ["en", "de"]],
    }), 3)
    next(lexical._frequencies(asked)(iter(blocks)))
    having = {w: sum(w in x for x in words) for w in ("alpha", "beta", "filler")}
    asked.weigh(np.array([having[w] for w in asked.terms.to_pylist()]), 384, sum(map(len, words)))
    scored, real = [], lexical.Asked.scores
    monkeypatch.setattr(lexical.Asked, "scores", lambda self, b, n, w: scored.append(w.tolist()) or real(self, b, n, w))
    monkeypatch.setattr(lexical, "QUERY_SLICE", 1)
    kinds = [pa.int64(), pa.string(), pa.float64()]
    (out,) = lexical._scored(asked, False, ["query_pk", "chunk_id", "score"], kinds)(iter(blocks + blocks[1:]))
    assert [w[0] for w in scored].count(True) <= 3  # nine blocks have its word

    mean = sum(map(len, words)) / 384
    def brute(terms, fine):
        found = []
        for n, x in enumerate(words):
            tf = {w: x.count(w) for w in terms if w in x}
            score = sum(
                3 * terms[w] * math.log(1 + (384 - having[w] + 0.5) / (having[w] + 0.5)) * c * 2.2
                / (c + 1.2 * (0.25 + 0.75 * len(x) / mean)) for w, c in tf.items()
            )
            if tf and fine(n):
                found.append((-round(score, 9), f"c{n:03}"))
        return sorted(found)[:3]

    got = sorted((r["query_pk"], -r["score"], r["chunk_id"]) for r in out.to_pylist())
    assert [g[1:] for g in got if g[0] == 7] == brute({"alpha": 1, "beta": 2}, lambda n: n % 20 == 3)
    assert {g[2] for g in got if g[0] == 9} <= {c for _, c in brute({"filler": 1}, lambda n: True)}


def test_hydrating_a_few_hits_does_not_shuffle_the_texts(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        chunks = spark.range(5_000).select(
            F.concat(F.lit("c"), "id").alias("chunk_id"), F.repeat(F.lit("x"), 2_000).alias("text"),
            F.lit(None).cast("string").alias("section_title"),
        )
        hits = spark.createDataFrame(
            [(1, "c7", 1), (1, "gone", 2), (1, "c9", 3), (2, "c7", 1), (2, "c7", 2)], "query_pk long, chunk_id string, rank int"
        )
        found = fusion.hydrate(hits, chunks)
        rows = sorted((r.query_pk, r["rank"], r.chunk_id, len(r.text)) for r in found.collect())
        assert rows == [(1, 1, "c7", 2_000), (1, 2, "c9", 2_000), (2, 1, "c7", 2_000), (2, 2, "c7", 2_000)]
        assert "SortMergeJoin" not in found._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
