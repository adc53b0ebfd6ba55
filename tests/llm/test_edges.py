"""Nulls, empty and very long texts, ties and repeats, empty tables, and columns with clashing names."""

import collections
import gzip
import itertools
import pickle
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark import Broadcast
from pyspark.sql import functions as F

import corpus_pipeline
from ragloom.functions import scale
from ragloom.functions.scale import work_path
from ragloom.llm import (
    collocations,
    common,
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
from tests.llm.test_catalog import covered, linked, plain_personal, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label long, size string, key string, row int"
LONG = " ".join(f"word{n % 977} and{n % 31}" for n in range(60_000))


def table(spark, rows):
    return spark.createDataFrame([(d, t, lang, s, None, 1, "x", "y", 2) for d, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    near = "one two three four five six seven eight nine ten " * 4
    return table(spark, [
        (1, "alpha beta gamma delta", "en", "a"), (2, "alpha beta gamma delta", None, None), (2, None, "en", "a"),
        (None, "alpha beta gamma delta", "en", "b"), (None, None, None, None), (3, "", "fr", "b"), (4, " \n\t", "fr", "b"),
        (5, near, "en", "a"), (6, near + "x", "en", "a"), (6, near + "x", "en", "a"), (7, "123 456", "de", "c"),
        (8, LONG, "en", "c"), (9, LONG + " end", "en", "c"), (10, "Ünïcode ▁ \U0001f600 text\x00", "de", None),
    ])


@pytest.fixture(scope="module")
def nothing(spark):
    return table(spark, [])


# ---- language, dedup, join, mixing, codec --------------------------------------------------------------------------


def test_language_edges(spark, odd, nothing):
    model = language_id.train(odd, steps=20)
    rows = language_id.predict(odd, model, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd.count()
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or r.score == 0)
    assert language_id.train(nothing) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}
    assert language_id.predict(nothing, model).collect() == []
    clash = odd.withColumn("lang_pred", F.lit(1)).withColumn("_bytes", F.lit(b"")).withColumn("score", F.lit("s"))
    assert language_id.predict(clash, model).count() == odd.count()


def test_windows_cover_the_text():
    text = bytes(range(1, 201)) * 7
    start, end, row = language_id._window_index(np.array([0, 0, 5, len(text)]))
    assert (end - start).sum() == len(text) and set(row.tolist()) == {1, 2}
    assert language_id.cut(text).reshape(-1)[: len(text)].tobytes() == text


def test_exact_dedup_edges(odd, nothing):
    rows = exact_dedup.deduplicate(odd).collect()
    assert len(rows) == odd.count()
    by_text = collections.defaultdict(list)
    for r in rows:
        by_text[r.text_sha256].append(r)
    for group in by_text.values():
        assert sum(r.kept for r in group) == 1 and {r.group_size for r in group} == {len(group)}
        ids = [r.doc_id for r in group if r.doc_id is not None]
        assert {r.keep_id for r in group} == {max(ids, default=None)}
    kept = exact_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.count() == len(by_text)
    assert exact_dedup.deduplicate(nothing).collect() == [] and exact_dedup.keep_first(nothing).collect() == []


def test_digest_index_persists(spark, odd):
    path = work_path(spark)
    index = exact_dedup.DigestIndex(spark, path, 4)
    first = odd.filter("doc_id < 5")
    exact_dedup.deduplicate(first, index=index)
    again = exact_dedup.DigestIndex(spark, path, 4)
    known = {bytes(r.digest) for r in again.table().collect()}
    assert len(known) == 3
    rows = exact_dedup.deduplicate(odd, index=again).collect()
    assert not any(r.kept for r in rows if bytes.fromhex(r.text_sha256) in known)
    assert again.table().count() == len({r.text_sha256 for r in rows})
    plan = odd.select(F.unhex(F.sha2("text", 256)).alias("digest")).join(again.table().hint("merge"), "digest", "left_anti")
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_hot_groups_meet_without_shuffle(spark):
    rows = spark.range(3_000).select("id", F.when(F.col("id") < 2_000, 0).otherwise(F.col("id")).alias("k"))
    groups = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low"))
    got = common.join_groups(rows, groups, "k", "n").collect()
    assert len(got) == 3_000 and all(r.low == (0 if r.id < 2_000 else r.id) for r in got)


def test_near_duplicate_edges(odd, nothing):
    rows = ngram_join.near_duplicates(odd, 3, 90).collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(set)
    for r in rows:
        by_id[r.doc_id].add((r.n_shingles, r.component_id))
    assert by_id[1] == {(2, 1)} and by_id[2] == {(2, 1), (0, 2)} and by_id[3] == {(0, 3)} and by_id[4] == {(0, 4)}
    assert by_id[None] == {(2, 1), (0, None)} and by_id[7] == {(1, 7)}
    assert {c for _, c in by_id[8] | by_id[9]} == {8}
    assert ngram_join.near_duplicates(nothing).collect() == []
    kept = ngram_join.keep_one(odd, 3, 90)
    assert kept.columns == odd.columns


def test_one_row_of_each_component_stays(spark, odd, nothing):
    got = collections.Counter((r.doc_id, r.text) for r in ngram_join.keep_one(odd, 3, 90).collect())
    near = "one two three four five six seven eight nine ten " * 4
    assert got == collections.Counter([
        (1, "alpha beta gamma delta"), (2, None), (None, None), (3, ""), (4, " \n\t"), (5, near), (7, "123 456"),
        (8, LONG), (10, "Ünïcode ▁ \U0001f600 text\x00"),
    ])
    base, other = " ".join(f"a{n}" for n in range(60)), " ".join(f"b{n}" for n in range(60))
    rows = [(1, base), (5, base + " x"), (5, other), (7, other), (None, base + " y"), (9, "c d e f g"), (9, "c d e f g"), (9, "C d e f g")]
    rows += [(None, "h i j k l")] * 300 + [(None, "H i j k l")]
    kept = ngram_join.keep_one(table(spark, [(d, t, "en", "a") for d, t in rows]), 5, 80).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept) == [(0, "h i j k l"), (1, base), (5, other), (9, "c d e f g")]
    assert ngram_join.keep_one(nothing).collect() == []


@pytest.mark.parametrize("block", [4, 2_048])
def test_near_copies_in_large_groups(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(7)
    rows = []
    for group in range(3):
        base = [f"w{rng.randint(0, 300)}" for _ in range(120)]
        for copy in range(25):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randint(0, 119)] = f"x{rng.randint(0, 10**6)}"
            rows.append((group * 100 + copy, " ".join(words), "en", "a"))
    rows += [(1_000 + n, "the very common line", "en", "a") for n in range(20)]
    rows += [(2_000 + n, f"the very common line {n}", "en", "a") for n in range(20)]
    for words, percent in ((3, 90), (2, 80)):
        found = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(table(spark, rows), words, percent).collect()}
        assert found == linked({d: shingles(t, words) for d, t, _, _ in rows}, percent)


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 9, (12, ngram_join.GROUPS))
    counts = np.clip(np.repeat(base, 20, 0) + (rng.random((240, ngram_join.GROUPS)) < 0.03), 0, 255).astype(np.uint8)
    sizes, excess = counts.sum(1).astype(np.int64), rng.integers(0, 3, 240)
    rests = sizes - rng.integers(0, 9, 240)
    tree = ngram_join.Tree(sizes, counts, excess, rests, 90)
    got = {tuple(sorted(p)) for a, b in tree.meet(tree) for p in zip(a.tolist(), b.tolist(), strict=True)}
    bound = np.minimum(counts[:, None], counts[None]).sum(2, dtype=int) + np.minimum(excess[:, None], excess[None])
    bound = np.minimum(bound, np.minimum(rests[:, None], rests[None]))
    hit = bound >= ngram_join.required(sizes[:, None], sizes[None], 90)
    hit &= (sizes[:, None] * 100 >= sizes[None] * 90) & (sizes[None] * 100 >= sizes[:, None] * 90) | hit
    assert got == {(a, b) for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True)}


def test_mixing_edges(odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == r.times * r.size and 0 <= r.times <= 3 for r in rows)
    assert all(r.size == 0 for r in rows if r.doc_id in (3, 4))
    assert mixing.mix(nothing).collect() == []
    out = mixing.apply_mix(odd)
    assert out.columns == odd.columns and out.count() == sum(r.times for r in rows)


def test_targets_share_the_excess(spark):
    sizes = [("a", 100, 1), ("b", 100, 2), ("c", 1, 3), (None, 0, 1)]
    frame = spark.createDataFrame(sizes, "source string, source_size long, weight long")
    got = {r.source: r.target for r in mixing.targets(frame, 3).collect()}
    assert got["c"] == 3 and got[None] == 0
    assert got["a"] == pytest.approx(66) and got["b"] == pytest.approx(132)


def test_codec_edges(odd, nothing):
    pieces = sentencepiece_codec.load_pieces()
    rows = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, pieces), pieces).collect()
    assert len(rows) == odd.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert sentencepiece_codec.encode(nothing, pieces).collect() == []
    assert sentencepiece_codec.decode_ids(pieces, [-1, 10**9, 0, 1]) == b""


def test_codec_sends_texts_once_in_small_batches(spark, odd):
    """A task gets each text once, the vocabulary as arrays, and batches of bounded size."""
    session = spark.newSession()
    pieces = sentencepiece_codec.load_pieces()
    documents = session.createDataFrame(odd.collect(), odd.schema)
    coded = sentencepiece_codec.round_trip(documents, pieces)
    sent = coded._jdf.queryExecution().optimizedPlan().children().head().output()
    assert sent.size() == len(documents.columns) + 1
    assert int(session.conf.get(scale.ARROW_LIMIT)) == scale.ARROW_BYTES
    twice = sentencepiece_codec.round_trip(documents, pieces, text="TEXT")
    assert twice.exceptAll(coded).isEmpty() and coded.count() == twice.count() == odd.count()
    trie = pickle.loads(pickle.dumps(sentencepiece_codec.Trie(pieces)))
    own = {name for name, value in vars(trie).items() if isinstance(value, dict)}
    assert not own and len(trie.chars) < len(pieces.ids)


def test_samples_follow_the_lattice():
    """Frequencies of the sampled segmentations of a word against the weights of all its paths."""
    pieces = sentencepiece_codec.load_pieces(exponent=0.2)
    lattices = sentencepiece_codec._Lattices(pieces)
    count, word = 20_000, "there"
    ids, sizes = sentencepiece_codec.encode_texts(lattices, [word] * count, np.arange(count).astype(np.uint64))
    ends = np.cumsum(sizes)
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(ids, ends[:-1]))
    weights = {}

    def walk(rest, path, weight):
        if not rest:
            weights[path] = weight
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces.ids:
                walk(rest[n:], (*path, pieces.ids[rest[:n]]), weight * pieces.weights[rest[:n]])

    walk("▁" + word, (), 1.0)
    total = sum(weights.values())
    assert set(seen) <= set(weights)
    for path, weight in weights.items():
        share = weight / total
        assert abs(seen[path] / count - share) < 5 * (share / count) ** 0.5 + 1e-4


# ---- licences, top-k, pages, archives, repeats ---------------------------------------------------------------------


def test_license_edges(spark, odd, nothing):
    assert license_scan.scan(odd).collect() == [] and license_scan.scan(nothing).collect() == []
    mit = license_scan.TEMPLATES["MIT"]
    changed = mit.replace("sublicense", "sub license").replace("merge, ", "").replace("Software", "Ware", 2)
    text = "é " * 50 + LONG[:3_000_000] + "\n" + changed + "\nmore. " + license_scan.TEMPLATES["MIT notice"]
    rows = license_scan.scan(table(spark, [(1, text, "en", "a"), (1, text, "en", "a")])).collect()
    assert len(rows) == 4 and {r.license for r in rows} == {"MIT", "MIT notice"}
    found = next(r for r in rows if r.license == "MIT")
    assert found.coverage > 0.95 and text[found.span_start : found.span_end] == changed.rstrip(".")


@pytest.mark.parametrize("name", ["MIT notice", "Apache-2.0 notice", "CC-BY-NC-4.0 notice", "CC-BY-4.0 notice", "GPL-3.0 notice", "MIT"])
def test_repeated_notices_are_all_found(name):
    index, notice = license_scan.build_index(), license_scan.TEMPLATES[name]
    for between in range(13):
        for count in (1, 2, 3, 50):
            text, spans = "é ", []
            for n in range(count):
                text += " ".join(f"foo{n}x{k}" for k in range(between)) + "\n"
                spans.append((len(text), len(text) + len(notice.rstrip("."))))
                text += notice
            found = [(m[1], m[2]) for m in license_scan.scan_text(index, text) if m[0] == name and m[4] == 1]
            assert found == spans


def test_many_notices_across_parts(monkeypatch):
    index, notice = license_scan.build_index(), license_scan.TEMPLATES["MIT notice"]
    text = "".join(f"lib{n} {n}.0 {notice}\n" for n in range(2_000))
    whole = license_scan.scan_text(index, text)
    monkeypatch.setattr(license_scan, "PART_BYTES", 40_000)
    assert [m[3] for m in whole] == [5] * 2_000 and license_scan.scan_text(index, text) == whole


def test_topk_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, -0.25]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, None),
        (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (50, [1e30, 1.0]), (100, [0.1, 0.1]), (100, [0.1, 0.2]), (150, []),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk_search.top_k(frame, F.col("vec_id") % 50 == 0, k=3).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert sorted(got[0])[:1] == [(1, 50, 2**63 - 1)] and len(got[0]) == 3
    assert [v for _, v, _ in sorted(got[100])] == [50, 1, 2]
    assert 150 not in got and 7 not in {v for rows in got.values() for _, v, _ in rows}
    assert topk_search.top_k(frame.filter("vec_id = 1"), F.col("vec_id") % 50 == 0).collect() == []
    assert topk_search.top_k(frame.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_page_edges(spark):
    rows = [
        (1, None, None), (2, "u", ""), (3, "u", "no markup at all, just a sentence."), (4, "u", "<p>open <b>tags &am"),
        (5, "u", "<html><body><article><p>" + "a b. " * 200_000 + "</p></article></body></html>"), (5, "u", "<!-- only"),
        (6, "u", "<div " * 50), (7, "u", "<div>" * 3_000 + "deep text in here." + "</div>" * 3_000),
        (8, "u", '<body><header><h1>Site</h1></header><div class="cookie-notice">We use cookies</div><article><h1>Title '
                 "&amp; more</h1><p>First  para.</p><div class='ad'>Buy.</div><p>Second <b>bo</b>ld.</p><form><label>Mail"
                 '</label></form></article><section class="comments"><p>I like it.</p></section><footer>x</footer></body>'),
    ]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = collections.defaultdict(list)
    for r in got:
        texts[r.page_id].append(r.text)
        assert r.n_chars == len(r.text)
    assert texts[1] == [""] and texts[2] == [""] and texts[8] == ["Title & more First para. Second bold."]
    assert len(got) == len(rows) and max(map(len, texts[5])) == 5 * 200_000 - 1
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_dropped_elements_end_where_parsers_end_them():
    def read(source):
        return " ".join("".join("".join(t) for t in html_extraction.parse(source).texts if t is not None).split())

    assert read('<svg><svg><text>a</text></svg><rect y="1.5"/><text y="10%">b</text></svg><p>kept</p>') == "kept"
    assert read('<p y="1.5">one</p><div y="x"> two</div>') == "one two"
    assert read("<div><svg><path d='M0'><p>first</p> second</div> third") == "first second third"
    assert read("<div><math><mrow><mfrac>x</div><p>after</p>") == "after"
    assert read("<svg><foreignObject><div>in</div></foreignObject><title>t</title></svg>out") == "out"
    assert read("<svg><!-- <svg> --><g><a><b/></a></g></svg>out") == "out"
    assert read("<object><object>a</object>b</object>c<template><script>'</template>'</script>d</template>e") == "ce"
    assert read("<script>'<script>'</script>x<style>a<style></style>y") == "xy"
    assert read("<svg/>x<video><source><svg><p>fallback</p></video>y<svg>never closed") == "xy"


def test_values_of_y_on_given_pages(spark):
    page = "<body><article><p>A sentence that stays, whatever comes next.</p>{}</article></body>"
    marked = ['<svg><svg></svg><rect y="1.5"/></svg>', '<svg><g><rect y="10%"></g>', '<p y="none"></p>', '<math><mi y="2">']
    rows = [(n, "u", page.format(m)) for n, m in enumerate(["", *marked])]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"A sentence that stays, whatever comes next."} and len(got) == len(rows)


def test_messages_are_exact():
    """Marginals of a small tree against the sum over all labellings."""
    rng = np.random.default_rng(1)
    parents, groups = np.array([-1, 0, 0, 1, 1, 2]), np.array([0, 1, 2, 1, 0, 2])
    unary, pair = rng.normal(size=(6, 2)), rng.normal(size=(3, 2, 2))
    nodes, edges = html_extraction.marginals(unary, pair, parents, groups)
    total, ones, joint = 0.0, np.zeros(6), np.zeros((6, 2, 2))
    for bits in range(64):
        y = [(bits >> n) & 1 for n in range(6)]
        score = sum(unary[n, y[n]] for n in range(6)) + sum(pair[groups[n], y[parents[n]], y[n]] for n in range(1, 6))
        weight = np.exp(score)
        total += weight
        ones += weight * np.array(y)
        for n in range(1, 6):
            joint[n, y[parents[n]], y[n]] += weight
    assert np.allclose(np.exp(nodes[:, 1]), ones / total) and np.allclose(np.exp(edges[1:]), joint[1:] / total)


def test_archives(spark):
    big = "x" * 1_500
    rows = [
        (1, "http://a/1", big), (2, "http://a/2\r\nEvil: 1", big), (3, None, "short"), (4, "u", "short"), (5, "u", None),
        (None, "u", big), (6, "u", "ü" * 3_000_000), (6, "u", "other " * 300), (2, "u", big),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    folder = work_path(spark)
    manifest = warc.write(pages, folder, archive_bytes=2_000)
    records = warc.read(manifest).collect()
    assert len(records) == len(rows) and all(r.digest_ok for r in records)
    kinds = collections.Counter((r.record_id, r.record_type) for r in records)
    assert kinds[("urn:page:1", "revisit")] == 1 and kinds[("urn:page:2", "response")] == 2
    assert kinds[("urn:page:null", "revisit")] == 1 and kinds[("urn:page:6", "response")] == 2
    assert {len(r.payload or b"") for r in records if r.record_id == "urn:page:6"} == {6_000_000, 1_800}
    for row in manifest.collect():
        data = gzip.open(warc._open(row.archive)[1]).read()
        assert data.count(b"WARC/1.1\r\n") == row.records
    assert len(warc.round_trip(pages).collect()) == len(rows)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_archive_faults(tmp_path):
    good = [warc.member(warc.record("response", f"urn:page:{n}", "u", b"p" * n * 40_000)) for n in range(4)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(good))

    def read():
        with path.open("rb") as stream:
            return [warc._read_one("a", at, chunks, True) for at, chunks in warc._Members(stream)]

    found = read()
    assert [r["offset"] for r in found] == [0, *np.cumsum([len(g) for g in good])[:-1].tolist()]
    assert [r["payload_length"] for r in found] == [0, 40_000, 80_000, 120_000] and all(r["digest_ok"] for r in found)
    bad = warc.record("response", "urn:page:9", "u", b"payload").replace(b"payload", b"paxload")
    path.write_bytes(good[1] + warc.member(bad) + good[2])
    assert [r["digest_ok"] for r in read()] == [True, False, True]
    path.write_bytes(good[1] + good[3][:-30])
    with pytest.raises((EOFError, RuntimeError)):
        read()


@pytest.mark.parametrize("hash_bytes", [1, 1 << 17])
def test_repeat_edges(spark, monkeypatch, nothing, hash_bytes):
    monkeypatch.setattr(suffix_dedup, "HASH_BYTES", hash_bytes)
    rng = random.Random(5)
    texts: list = [None, "", "x" * 41, "x" * 40, "y" * 40, "ab" * 300, "c" * 5_000]
    for _ in range(50):
        text = "".join(rng.choice("abcdé ") for _ in range(rng.choice([10, 60, 300, 700])))
        source = rng.choice(texts) or ""
        at = rng.randint(0, len(source))
        texts.append(text[:50] + source[at : at + rng.randint(0, 300)] + text[50:])
    texts += [texts[9], texts[9]]
    rows = [(n if n else None, t, "en", "a") for n, t in enumerate(texts)]
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(table(spark, rows), 40, 12).collect()}
    raw = [(t or "").encode() for t in texts]
    for (d, _, _, _), text, mask in zip(rows, raw, covered(raw, 40), strict=True):
        kept = bytes(b for b, gone in zip(text, mask, strict=True) if not gone)
        assert (got[d].n_bytes, got[d].n_removed, bytes(got[d].kept_bytes)) == (len(text), sum(mask), kept)
    assert suffix_dedup.remove_repeats(nothing).collect() == []


def test_long_texts_are_cut_into_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", 500)
    import pyarrow as pa

    text = bytes(np.random.default_rng(2).integers(97, 123, 5_000).astype(np.uint8))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2]), pa.array([7, 8]), pa.array([text, text], pa.binary())], ["doc_id", "th", "text"]
    )
    rows = pa.Table.from_batches(list(suffix_dedup._records(200, 64)(iter([batch])))).to_pylist()
    seen = collections.Counter()
    for r in rows:
        start, windows = r["place"] >> 25, (r["place"] >> 1) & ((1 << 24) - 1)
        seen.update((r["doc_id"], n) for n in range(start, start + windows))
    assert set(seen.values()) == {1} and len(seen) == 2 * (5_000 - 199)


def test_runs_longer_than_memory(monkeypatch):
    """Classifying hashes that don't fit gives the same records to search or more, and the same repeats."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.sort(rng.integers(0, 4, 400))
    content = rng.integers(0, 30, 400)
    order = np.lexsort((content, keys))
    table_ = pa.table({
        "hash": keys[order], "content": content[order], "doc_id": np.arange(400), "th": np.arange(400),
        "place": np.full(400, 2),
    })
    batches = table_.to_batches(max_chunksize=7)
    whole = pa.Table.from_batches(list(suffix_dedup._classify(iter(batches)))).to_pylist()
    monkeypatch.setattr(suffix_dedup, "HELD_RECORDS", 20)
    parts = pa.Table.from_batches(list(suffix_dedup._classify(iter(batches)))).to_pylist()
    covered_ = lambda rows: {r["doc_id"] for r in rows if r["kind"] == 0}
    asked = lambda rows: {(r["hash"], r["content"]) for r in rows if r["kind"] > 0}
    assert covered_(parts) == covered_(whole) and asked(parts) == asked(whole)


def test_components_of_hubs_and_chains(spark):
    edges = [(0, n) for n in range(1, 200)] + [(n, n + 1) for n in range(1_000, 1_060)] + [(5, 5), (9_000, 8_000)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in common.components(frame, "a", "b").collect()}
    assert {got[n] for n in range(200)} == {0} and {got[n] for n in range(1_000, 1_061)} == {1_000}
    assert got[9_000] == 8_000 and len(got) == 200 + 61 + 2


def test_pipeline_edges(spark, odd, nothing):
    for docs in (nothing, odd):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            rows = stage(spark, docs, "unused")
            if name != "sentencepiece":
                assert rows.columns == columns
            docs = spark.createDataFrame(rows.collect(), rows.schema)


# ---- personal data ---------------------------------------------------------------------------------------------------


def test_personal_data_edges(spark, odd, nothing):
    rows = personal_data.find(odd).collect()
    assert len(rows) == odd.count() and all(r.n_email == 0 and r.spans == "" for r in rows)
    assert personal_data.find(nothing).collect() == []
    clash = odd.withColumn("spans", F.lit(1)).withColumn("_bytes", F.lit(b"")).withColumn("n_ip", F.lit("s"))
    assert personal_data.find(clash).count() == odd.count()
    text = "x " * 400_000 + "ann@example.com " + "7" * 100_000 + " +49 (30) 123-4567 and 4111 1111 1111 1111"
    got = personal_data.find(table(spark, [(1, text, "en", "a"), (1, text, "en", "a")]), keep=["doc_id"]).collect()
    assert [(r.n_email, r.n_phone, r.n_card) for r in got] == [(1, 1, 1)] * 2


def test_fixed_patterns_against_the_definition():
    rng = random.Random(4)
    for _ in range(3_000):
        text = "".join(rng.choice(["a", "B", "7", "12", "255", "256", ".", "..", "@", "-", " ", "+", "(", ")", "_", "ü"]) for _ in range(30))
        assert personal_data.base_spans(text) == plain_personal(text)


def test_network_gradient_and_decoding():
    classes, tags, _ = personal_data.labelled_windows(3, 12, 5)
    model = personal_data.Model.new(2, hidden=3)
    model.params = [p.astype(np.float64) for p in model.params]
    _, grads = personal_data.loss_and_gradients(model, classes, tags)
    rng = np.random.default_rng(1)
    for p, g in zip(model.params, grads, strict=True):
        for at in {int(a) for a in rng.choice(np.flatnonzero(g.reshape(-1)), 3)}:
            flat, step = p.reshape(-1), 1e-2
            before = flat[at]
            flat[at] = before + step
            high, _ = personal_data.loss_and_gradients(model, classes, tags)
            flat[at] = before - step
            low, _ = personal_data.loss_and_gradients(model, classes, tags)
            flat[at] = before
            assert (high - low) / (2 * step) == pytest.approx(g.reshape(-1)[at], rel=0.03, abs=3e-3)
    emission = rng.normal(size=(4, 2, personal_data.TAGS)).astype(np.float32)
    moved, first = model.params[6] + personal_data.MOVES, model.params[7] + personal_data.START
    got = personal_data.viterbi(model, emission)
    for n in range(2):
        score = lambda y: first[y[0]] + sum(emission[t, n, y[t]] for t in range(4)) + sum(moved[a, b] for a, b in zip(y, y[1:], strict=False))  # noqa: E731, B023
        assert tuple(got[n]) == max(itertools.product(range(personal_data.TAGS), repeat=4), key=score)


def test_network_on_held_out_spans():
    model = personal_data.train()
    right = wrong = missed = 0
    _, _, texts = personal_data.labelled_windows(150, 300, 99)
    classes, tags, _ = personal_data.labelled_windows(150, 300, 99)
    for text, row, y in zip(texts, classes, tags, strict=True):
        found = personal_data.viterbi(model, personal_data.emissions(model, row[None]))[0]
        spans = lambda z: {(m.start(), m.end(), m.group()[0]) for m in re.finditer(r"ab*|cd*|ef*|gh*", "".join("-abcdefgh"[v] for v in z))}
        a, b = spans(found), spans(y)
        right, wrong, missed = right + len(a & b), wrong + len(a - b), missed + len(b - a)
    assert right >= 0.9 * (right + wrong) and right >= 0.9 * (right + missed)


def test_added_spans(spark):
    text = "Call 0049 30 1234 567 or write to ann.lee (at) example (dot) com, server 10[.]20[.]30[.]40. " * 2
    clean = "Version 3.1.2 of 2024-01-15 12:30:00, order 1234567890123456, pages 10-20, 3,000,000 readers. " * 20
    rows = personal_data.find(table(spark, [(1, text, "en", "a"), (2, clean, "en", "a")]), keep=["doc_id"]).collect()
    found = {r.doc_id: r for r in rows}
    assert found[1].n_added >= 2 and found[2].n_added == 0
    assert personal_data.reconcile([(0, 0, 9, 2.0), (5, 0, 12, 1.0), (11, 1, 15, 1.0), (20, 2, 30, 1.0)]) == [(0, 0, 12), (20, 2, 30)]
    for length in (0, 1, 64, 65, 256, 257, 1_000, 5_000):
        starts = personal_data.window_starts(length)
        for at in range(0, max(length - personal_data.OVERLAP, 0), 7):
            assert ((starts <= at) & (at + personal_data.OVERLAP <= starts + personal_data.WINDOW)).any()


# ---- collocations ----------------------------------------------------------------------------------------------------


def plain_collocations(docs, least):
    low = {n: n + 32 for n in range(65, 91)}
    f, total = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 6):
                f[lang].update(tuple(words[n : n + k]) for n in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        wanted = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {
            q[n : n + k] for q, a in wanted.items() for k in range(2, len(q)) for n in range(len(q) - k + 1)
            if 100 * a >= 100 * wanted.get(q[n : n + k], 1 << 60)
        }
        rows = []
        for p, a in wanted.items():
            if p not in inside:
                score, k = min((1_000 * a * total[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((score, a, " ".join(p), counts[p[:k]], counts[p[k:]]))
        rows.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, n, r[2], r[1], r[3], r[4], total[lang], r[0]) for n, r in enumerate(rows[:2_000], start=1)]
    return sorted(out)


def test_collocations(spark, odd, nothing, monkeypatch):
    assert collocations.mine(nothing).collect() == []
    rng = random.Random(2)
    rows = [(n, " ".join(rng.choice(["a", "B", "c", "d", "é", "a.", "b,", "\t", "x\u00a0y"]) for _ in range(80)), rng.choice(["en", None, ""]), "s") for n in range(60)]
    rows += [(1, "one two three four five six. " * 40, "en", "s")] * 3 + [(2, None, "en", "s"), (3, "", None, "s"), (4, ".,;", "fr", "s")]
    docs = table(spark, rows)
    expected = plain_collocations([(t, lang) for _, t, lang, _ in rows], 6)
    assert sorted(tuple(r) for r in collocations.mine(docs, min_count=6).collect()) == expected
    for name, value in (("SHARD", 16), ("SHARDS_A_PASS", 2), ("HELD", 50), ("CHUNK", 40), ("PIECE_BYTES", 300)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(tuple(r) for r in collocations.mine(docs, min_count=6).collect()) == expected


def test_double_array():
    rng = np.random.default_rng(0)
    keys = np.unique((rng.zipf(1.3, 40_000) % 900) * 10_000 + rng.zipf(1.2, 40_000) % 6_000)
    state, word = (keys // 10_000).astype(np.int32), (keys % 10_000).astype(np.int32)
    trie = collocations.DoubleArray.unpacked(collocations.DoubleArray.build(state, word).packed())
    assert (trie.step(state, word) == np.arange(len(keys))).all()
    other = rng.integers(0, 1_000, 20_000).astype(np.int32), rng.integers(0, 6_100, 20_000).astype(np.int32)
    known = set(keys.tolist())
    assert ((trie.step(*other) >= 0) == np.array([a * 10_000 + b in known for a, b in zip(*(x.tolist() for x in other), strict=True)])).all()


# ---- hard negatives --------------------------------------------------------------------------------------------------


def plain_negatives(rows):
    fine = [(i, v, lab) for i, v, lab in rows if i is not None and v is not None and lab is not None and all(x is not None and np.isfinite(x) for x in v)]
    q = [(i, [int(np.floor(256 * x)) for x in v], lab) for i, v, lab in fine]
    out = []
    for i, v, lab in q:
        if i % 10 == 0:
            scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, other) for j, w, other in q if j != i and len(w) == len(v)]
            for s, p, _ in sorted(x for x in scores if x[2] == lab)[:5]:
                near = sorted(x for x in scores if x[2] != lab and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
                out += [(i, p, n, j, -s, -t) for n, (t, j, _) in enumerate(near, start=1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(n, [float(x) for x in rng.normal(size=6).round(2)], int(rng.integers(0, 3))) for n in range(300)]
    rows += [(n, rows[0][1], n % 3) for n in range(300, 420)]  # copies of one vector
    rows += [(500, None, 1), (510, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (520, [float("nan")] * 6, 1), (530, [1.0] * 6, None),
             (None, [1.0] * 6, 1), (540, [0.5, 0.25], 1), (541, [0.5, 0.5], 1), (542, [0.4, 0.4], 2), (550, [], 2), (551, [], 2), (552, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("x", F.lit(1)).withColumn("anchor", F.lit("a"))
    expected = plain_negatives(rows)
    mine = lambda d: sorted(tuple(r) for r in hard_negatives.mine(d, F.col("vec_id") % 10 == 0).collect())
    assert expected and mine(df) == expected
    for name, value in (("BLOCK", 7), ("SHELF", 3), ("SLICE", 11), ("TILE", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert mine(df.repartition(5)) == expected
    assert mine(df.limit(0)) == [] and mine(df.filter("vec_id % 10 = 3")) == []


def test_curve_and_bounds():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    key = hard_negatives.hilbert_keys(points, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(key)], axis=0)).sum(1) == 1).all()
    rng = np.random.default_rng(6)
    x, block = rng.integers(-50, 50, (9, 5)).astype(float), rng.integers(-50, 50, (30, 5)).astype(float)
    one = hard_negatives.Slice(np.arange(9), np.array(["a"] * 9, object), {5: (np.arange(9), x)}, True, 5, *[np.zeros((9, 1))] * 3)
    _, least, most = one.bounds(5, block.min(0)[None], block.max(0)[None])
    scores = x @ block.T
    assert (least <= scores).all() and (scores <= most).all()


# ---- mended cases ----------------------------------------------------------------------------------------------------


def test_articles_with_noise_between_paragraphs():
    model = html_extraction.train()
    line = "The long river ran past the old mill and the town beyond it, while people watched from the bridge."
    noise = ['<p class="notice">Note this.</p>', '<p class="comment">I like it.</p>', '<div class="ad">Buy this.</div>', "<footer>Foot.</footer>",
             "<aside><p>More here.</p></aside>", "<nav><a href='/'>Home</a></nav>"]
    for wrap, count, size in itertools.product(("<article>{}</article>", '<div id="content">{}</div>'), range(5), (1, 3, 5)):
        for between in itertools.combinations(noise, count):
            parts = [f"<p>{n} {line}</p>" + (between[n] if n < count else "") for n in range(size)] + list(between[size:])
            page = f"<html><body><header><a href='/'>Site</a></header>{wrap.format(''.join(parts))}<footer>&copy; x</footer></body></html>"
            assert html_extraction.texts_of(model, [page]) == [" ".join(f"{n} {line}" for n in range(size))]
    page = "<article><p>One <math><mi>x</mi></math> two.</p><noscript><p>Three.</p></noscript><object>four</object></article>"
    assert html_extraction.texts_of(model, [page])[0].split() == ["One", "x", "two.", "Three.", "four"]


def test_licences_with_words_inserted_or_changed():
    index = license_scan.build_index()
    words = license_scan.TEMPLATES["MIT"].split()
    longer = " ".join([*words[:80], *[f"extra{n}" for n in range(14)], *words[80:]])
    assert [m[0] for m in license_scan.scan_text(index, longer)] == ["MIT"]
    for text in ("Released under our MIT License.", "Released under the new MIT License."):
        assert [m[0] for m in license_scan.scan_text(index, text)] == ["MIT notice"]
    for count, gap in itertools.product((2, 3, 50), (0, 1, 5, 12)):
        text = " ".join(["Released under the MIT License." + " word" * gap] * count)
        assert len(license_scan.scan_text(index, text)) == count


def test_mixing_without_ids(spark):
    rows = [(n if n % 3 else None, f"w{n} b c d e f g h i j", "en", "xy"[n % 2]) for n in range(3_000)]
    taken = collections.Counter()
    for r in mixing.mix(table(spark, rows)).collect():
        taken[r.source] += r.taken
        target = {"x": 10_000, "y": 20_000}[r.source]
        assert r.target == pytest.approx(target)
    assert taken == {"x": 10_000, "y": 20_000}


def test_a_long_word_in_blocks(monkeypatch):
    lattices = sentencepiece_codec._lattices_of(sentencepiece_codec.load_pieces())
    text = "".join(random.Random(3).choice("etaoinshr") for _ in range(60_000))
    seeds = np.array([7, 8], np.uint64)
    ids, sizes = sentencepiece_codec.encode_texts(lattices, [text, "and a short one"], seeds)
    data, ends = lattices.decode(ids, sizes)
    assert data[: ends[0]].tobytes().decode() == " " + text and data[ends[0] :].tobytes() == b" and a short one"
    plain = sentencepiece_codec.encode_texts(lattices, ["wonderfully"], seeds)[0]
    monkeypatch.setattr(sentencepiece_codec, "LONG_WORD", 3)
    monkeypatch.setattr(sentencepiece_codec, "LONG_BLOCK", 2)
    assert sentencepiece_codec.encode_texts(lattices, ["wonderfully"], seeds)[0].tolist() == plain.tolist()


def test_counts_of_tasks_are_summed_by_slices():
    """Accepting states of two tries and three tasks, over more than one slice and with states no task meets."""
    rng = np.random.default_rng(9)
    size = 2 * collocations.SLICE + 7
    plain, batches = {}, []

    class Trie:
        def __init__(self, shard):
            self.value = collocations.DoubleArray.build(np.arange(size, dtype=np.int32) + 1, np.full(size, 5, np.int32)), (
                rng.permutation(size).astype(np.int32) * 2 + shard + 1
            )

    tries = [(shard, Trie(shard)) for shard in (0, 1)]
    for _ in range(3):
        state = rng.integers(0, size // 2, 4_000).astype(np.int32)
        words = np.full(len(state), 5, np.int32)
        given = pa.RecordBatch.from_pydict(
            {"words": [words.tobytes()], "before": [state.tobytes()], "state": pa.nulls(1, pa.binary())}
        )
        out = list(collocations._advance(tries, 2, False)(iter([given])))
        batches += [b for b in out if b.column("shard").null_count == 0]
        for s in state[:-1][state[:-1] > 0]:
            for _, trie in tries:
                number = int(trie.value[1][s - 1])
                plain[number] = plain.get(number, 0) + 1
    found = [row for b in collocations._sum_slices(iter(batches)) for row in b.to_pylist()]
    assert {r["state"]: r["a"] for r in found} == plain and len(found) == len(plain)


def test_counts_of_words_and_neighbours_travel_as_arrays(monkeypatch):
    monkeypatch.setattr(collocations, "HELD", 64)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"W{n}\u00e4" for n in rng.zipf(1.5, 300).clip(0, 400)) + f". {n}" for n in range(20)]
    langs = ["en", "de"] * 10
    column = pa.array([t.encode() for t in texts], pa.binary())
    batch = pa.RecordBatch.from_arrays([column, pa.array(langs)], ["text", "lang"])
    out = pa.Table.from_batches(collocations._read_texts(4)(iter([batch, batch])))
    rows = out.filter(pa.compute.is_null(out.column("words")))
    assert len(rows) <= 2 * 4 * 2 and out.num_rows - len(rows) >= 2  # languages, buckets, batches
    want = collections.Counter((lang, w.lower()) for t, lang in zip(texts, langs) for w in t.replace(".", " ").split() * 2)
    assert sum(rows.column("total").to_pylist()) == sum(want.values())
    got = {}
    for bucket in set(rows.column("bucket").to_pylist()):
        for r in collocations._sum_words(10)(rows.filter(pa.compute.equal(rows.column("bucket"), bucket))).to_pylist():
            assert (r["lang"], r["word"].decode()) not in got
            got[r["lang"], r["word"].decode()] = r["a"]
    assert got == {k: n for k, n in want.items() if n >= 10}

    states = [rng.integers(0, 40, 500).astype(np.int32) for _ in range(6)]
    batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in states], pa.binary())], ["state"])
    out = pa.Table.from_batches(collocations._neighbours(3)(iter([batch])))
    pairs = collections.Counter((a, b) for s in states for a, b in zip(s.tolist(), s[1:].tolist()) if a and b)
    assert 3 < len(out) <= 3 * 6  # handed on inside a batch, one row a bucket
    got = set()
    for bucket in range(3):
        summed = collocations._sum_pairs(3)(out.filter(pa.compute.equal(out.column("bucket"), bucket)))
        got |= {(r["prefix"], r["suffix"]) for r in summed.to_pylist()}
    assert got == {k for k, n in pairs.items() if n >= 3}


def test_collocations_store_no_hash_for_each_word(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(" ".join(f"w{n}" for n in rng.integers(0, 5, 5_000)) + ". end", ("en", None)[n % 2]) for n in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t, _ in rows], pa.binary()), pa.array(["en"] * 8)], ["text", "lang"])
    out = pa.Table.from_batches(collocations._read_texts(4, arrays=False)(iter([batch])))
    assert out.num_rows <= 4 and out.nbytes < 5_000
    stored = {}
    write = common.Scratch.write

    def noted(self, name, df):
        found = write(self, name, df)
        stored[name] = found.columns, found.agg(*[F.sum(F.octet_length(c)) for c, k in found.dtypes if k == "binary"] or [F.lit(0)]).first()
        return found

    monkeypatch.setattr(common.Scratch, "write", noted)
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    once = sorted(map(tuple, collocations.mine(docs, min_count=10, longest=2).collect()))
    assert sum(n or 0 for n in stored["read"][1]) < 10_000  # 320 KB as hashes
    # With several passes over the dictionaries the numbers are the same.
    monkeypatch.setattr(collocations, "SHARD", 8)
    monkeypatch.setattr(collocations, "SHARDS_A_PASS", 1)
    stored.clear()
    assert once and sorted(map(tuple, collocations.mine(docs, min_count=10, longest=2).collect())) == once
    assert "words1" in stored


def test_collocations_reach_the_driver_in_short_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(" ".join(f"w{n}" for n in rng.integers(0, 40, 3_000)), "en") for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(2)
    expected = sorted(map(tuple, collocations.mine(docs, min_count=6, longest=3).collect()))
    seen, ended, iterate = [], [], type(docs).toLocalIterator

    def counted(self, *args):
        for row in iterate(self, *args):
            seen.append(sum(len(x) for x in row if isinstance(x, (bytes, bytearray))))
            yield row

    def refused(self):
        raise AssertionError("a row for each word on the driver")

    monkeypatch.setattr(type(docs), "toLocalIterator", counted)
    monkeypatch.setattr(type(docs), "toPandas", refused)
    destroy = Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (ended.append(self), destroy(self, *a)))
    monkeypatch.setattr(collocations, "ROW_BYTES", 256)
    monkeypatch.setattr(collocations, "SHARD", 1_000)
    assert expected and sorted(map(tuple, collocations.mine(docs, min_count=6, longest=3).collect())) == expected
    # 40 words, 1,600 pairs in two tries and the phrases of three words.
    assert len(seen) > 50 and max(seen) <= 2 * 256 and len(ended) >= 3


def test_few_revisits_leave_pages_where_they_are(spark, monkeypatch):
    big = "y" * 2_000
    rows = [(n, f"u{n}", big + str(n % 50)) for n in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    off = {
        "spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    for name, value in off.items():
        spark.conf.set(name, value)
    try:
        few = warc.write(pages, work_path(spark))
        assert few.count() <= 8  # an archive for each split, as nothing is dealt out again
        monkeypatch.setattr(warc, "fits_broadcast", lambda df: False)
        many = warc.write(pages, work_path(spark))
        read = lambda m: sorted((r.record_id, r.record_type, r.refers_to_id or "", r.digest_ok) for r in warc.read(m).collect())
        assert read(few) == read(many) and sum(r[1] == "revisit" for r in read(few)) == 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        for name in list(off)[1:]:
            spark.conf.unset(name)
