"""Edge cases of metrics, judges, statistics, conversation rules and the knowledge graph."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ragloom.operators import conversation, judging, knowledge, metrics, statistics


@given(st.lists(st.sampled_from("abcd"), max_size=30), st.lists(st.sampled_from("abcd"), max_size=30))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert metrics.common_subsequence(a, b) == table[-1][-1]


def test_retrieval_edge_cases(spark):
    ranking = spark.createDataFrame(
        [(1, q, p, c) for q, cs in {1: "aab", 2: "xy", 3: "a", 4: "a"}.items() for p, c in enumerate(cs, 1)],
        "run_id long, query_pk long, position long, chunk_id string",
    )
    gold = spark.createDataFrame(
        [(1, "a", 2), (2, "z", 1), (3, "a", 0), (5, "a", 3)], "query_pk long, chunk_id string, relevance int"
    )
    rows = {(r["query_pk"], r["metric"]): r["value"] for r in metrics.retrieval_metrics(ranking, gold, [3]).collect()}
    # Query 4 has no gold and query 5 no ranking; a repeated hit counts twice; only zeros make every metric 0.
    assert {q for q, _ in rows} == {1, 2, 3}
    assert rows[1, "recall@3"] == 2.0 and rows[1, "mrr@3"] == 1.0 and rows[1, "ndcg@3"] > 1
    assert all(rows[q, m] == 0 for q in (2, 3) for m in ("recall@3", "mrr@3", "ndcg@3"))
    once = metrics.retrieval_metrics(ranking, gold, [3], dedupe=True)
    assert once.filter("query_pk = 1 AND value != 1").isEmpty()


def test_text_metrics_of_empty_texts(spark):
    pairs = spark.createDataFrame([("", "x"), ("der die", "und"), ("a b", "a b")], "pred string, gold string")
    rows = metrics.content_f1(metrics.rouge_l(pairs)).collect()
    assert [r["content_f1"] for r in rows] == [0.0, 0.0, 1.0]
    assert [r["rouge_l_recall"] for r in rows] == [0.0, 0.0, 1.0]


def test_citation_rules(spark):
    items = spark.createDataFrame(
        [(1, 1, '["a", {"chunkId": "b"}, {"id": ""}]'), (1, 2, "[]"), (1, 3, None), (1, 4, '["a", "a"]')],
        "run_id long, query_pk long, citations string",
    )
    gold = spark.createDataFrame([(1, "a", 1), (1, "c", 2), (2, "a", 1), (4, "a", 0)],
                                 "query_pk long, chunk_id string, relevance int")
    rows = metrics.citation_metrics(items, metrics.citations(items), gold).collect()
    found = {(r["query_pk"], r["metric"].split("_")[1]): r["value"] for r in rows}
    assert found == {
        (1, "recall"): 0.5, (1, "precision"): 0.5, (2, "recall"): 0.0, (2, "precision"): 1.0,
        (3, "recall"): 1.0, (3, "precision"): 1.0, (4, "recall"): 1.0, (4, "precision"): 0.0,
    }


@pytest.mark.parametrize(
    "raw, score",
    [
        ('{"score": 4}', 4), ('text {"score": "2"} more', 2), ('{"score": "2.5"}', 3), ('{"score": 9}', 5),
        ('{"score": 0}', 1), ('{"score": 4.5}', 4.5), ("none", 3), ('{"other": 1}', 3), (None, 3), ('{"a": {"score": 5}}', 5),
    ],
)
def test_judge_score(spark, raw, score):
    row = judging.judge_scores(judging.parse_judge(spark.createDataFrame([(raw,)], "raw string"))).first()
    assert row["score"] == score and row["normalized"] == (score - 1) / 4


def test_aggregate_of_one_and_none(spark):
    scores = spark.createDataFrame([("a", "m", 0.4)], "run string, metric string, value double")
    rows = {r["metric"]: tuple(r)[2:] for r in statistics.aggregate_runs(scores, ["m", "x"]).collect()}
    assert rows == {"m": (0.4, 0.4, 0.4, 1), "x": (0.0, 0.0, 0.0, 0)}


def test_bootstrap_is_repeatable_and_splits_a_hot_pair(spark):
    base = spark.range(300).select(F.col("id").alias("query_pk"), (F.col("id") % 7 / 10).alias("value"))
    better = base.withColumn("value", F.col("value") + 0.05 + F.col("query_pk") % 3 / 100)
    scores = base.withColumn("run", F.lit("a")).unionByName(better.withColumn("run", F.lit("b"))).withColumn("metric", F.lit("m"))
    pairs = spark.createDataFrame([("a", "b", "m"), ("a", "a", "m"), ("a", "c", "m")], "run_a string, run_b string, metric string")
    one = {r["run_b"]: r for r in statistics.paired_bootstrap(scores, pairs, 200).collect()}
    two = {r["run_b"]: r for r in statistics.paired_bootstrap(scores.repartition(3), pairs, 200).collect()}
    assert one == two
    assert one["b"]["delta_mean"] == pytest.approx(0.06) and one["b"]["p_value"] == 0.0 and one["b"]["half_width"] > 0
    assert one["a"]["p_value"] == 1.0 and one["c"]["n"] == 0 and one["c"]["p_value"] is None


def test_delta_labels(spark):
    rows = spark.createDataFrame(
        [("recall@5", 0.02, 0.0005), ("recall@5", -0.02, 0.02), ("h2_error_rate", -0.5, 0.2), ("h2_error_rate", 0.5, 0.005),
         ("recall@5", 0.0005, None)], "metric string, delta double, p_value double",
    )
    found = [(r["label"], r["mark"]) for r in statistics.annotate(rows).collect()]
    assert found == [("↑ +0.0200", "***"), ("↓ -0.0200", "*"), ("↓ -0.5000", ""), ("↑ +0.5000", "**"), ("≈0", "")]


def test_latencies_without_success(spark):
    rows = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, True)], "k string, latency double, success boolean")
    found = {r["k"]: r for r in statistics.latency_summary(rows, ["k"]).collect()}
    assert found["a"]["success_rate"] == 0 and found["a"]["p95_latency"] is None
    assert found["b"]["p50_latency"] == found["b"]["p95_latency"] == 2.0


@pytest.mark.parametrize(
    "text, intent, confidence",
    [
        ("Hallo, ich brauche einen Antrag", "process_related", 0.95), ("hi", "greeting", 0.95), ("xy", "unclear", 0.8),
        ("Hallo!", "greeting", 0.95), ("hallo du da", "greeting", 0.9), ("Hallo, alles gut?", "ambiguous", None),
        ("Na, wie geht es dir heute so", "chitchat", 0.9), ("Was kostet das eigentlich", "process_related", 0.7),
        ("Was ist das", "ambiguous", None), ("Professor Meier", "ambiguous", None),
    ],
)
def test_intents(spark, text, intent, confidence):
    row = conversation.classify_queries(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["intent"], row["confidence"]) == (intent, confidence)


def test_history_over_small_blocks(spark, monkeypatch):
    from ragloom.functions import scale

    rows = spark.range(40).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"),
    )
    plain = {r["turn"]: (r["history_text"]) for r in conversation.history_window(rows, 2, 150, False).collect()}
    facts = {r["turn"]: (r["history"], r["last_assistant_chars"]) for r in conversation.with_history_facts(rows).collect()}
    monkeypatch.setattr(conversation, "BLOCK_ROWS", 4)
    monkeypatch.setattr(conversation, "halo_blocks", lambda d, i, b, a: scale.halo_blocks(d, i, b, a, width=8))
    assert plain == {r["turn"]: (r["history_text"]) for r in conversation.history_window(rows, 2, 150, False).collect()}
    again = {r["turn"]: (r["history"], r["last_assistant_chars"]) for r in conversation.with_history_facts(rows).collect()}
    assert facts == again and facts[0] == (0, None) and facts[12] == (12, 3)
    assert plain[5] == "Assistent: t1\nNutzer: t2\nAssistent: t3\nNutzer: t4"


def test_overlap_with_a_hot_item_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(knowledge, "HOT_ITEM_NODES", 20)
    items = {i: {f"a{i // 4}", f"b{i % 30}", f"c{i % 17}"} | ({"hot"} if i % 3 == 0 else set()) for i in range(120)}
    nodes = spark.createDataFrame([(i, sorted(x)) for i, x in items.items()], "node_id long, entities array<string>")
    for least in (1, 2, 3):
        found = {(r["src"], r["dst"]): r["items"] for r in knowledge.overlap_edges(nodes, "entities", least).collect()}
        expected = {
            (i, j): sorted(items[i] & items[j]) for i in items for j in items if i < j and len(items[i] & items[j]) >= least
        }
        assert found == expected


def test_draws_are_md5_in_pieces(monkeypatch):
    monkeypatch.setattr(statistics, "DIGESTS", 100)
    for seed, i, low, high in ((42, 0, 0, 1_234), (42, 9_999, 995, 1_010), (10**50, 3, 0, 20)):
        expected = [
            int.from_bytes(hashlib.md5(b"%d:%d:%d" % (seed, i, j)).digest()[:4], "big") for j in range(low, high)
        ]
        assert statistics._Draws(seed, low, high).of(i).tolist() == expected


def test_slices_share_their_draws(monkeypatch):
    """Two slices of one pair: each number is drawn once per iteration, in pieces, whatever the slices are."""
    class Sent:
        def __init__(self, value):
            self.value = value

    made = []
    draw = statistics._Draws.of
    monkeypatch.setattr(statistics._Draws, "of", lambda self, i: made.append(len(self.numbers)) or draw(self, i))
    monkeypatch.setattr(statistics, "DRAWN", 30)
    values, pairs = np.arange(100.0)[:, None], np.array([5])
    sent = [Sent([(100, 0, pairs, values[:60])]), Sent([(100, 60, pairs, values[60:])])]
    batches = statistics._iteration_sums(sent, 10, 42)(iter([pa.RecordBatch.from_arrays([pa.array([0])], ["id"])]))
    total = {}
    for r in pa.Table.from_batches(batches).to_pylist():
        total[r["i"]] = total.get(r["i"], 0) + r["total"]
    assert sum(made) == 10 * 100
    for i in range(10):
        drawn = [int.from_bytes(hashlib.md5(b"42:%d:%d" % (i, j)).digest()[:4], "big") % 100 for j in range(100)]
        assert total[i] == sum(drawn)
