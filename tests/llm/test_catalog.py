"""Every query of the subpackage: against its SQL where there is some, else against a plain version."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import pytest

import corpus_pipeline
from ragloom.llm import catalog, html_extraction, license_scan, sentencepiece_codec

DIRECTORY = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SPACES = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in ("documents", "embeddings", "pages"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIRECTORY}/{name}.parquet'")
    return connection


@pytest.fixture(scope="module")
def documents(duck):
    return duck.execute("SELECT doc_id, text, lang FROM documents").fetchall()


def _same(a, b):
    return math.isclose(a, b, rel_tol=1e-9) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_sql(spark, duck, name):
    frame = catalog.QUERIES[name](spark, DIRECTORY)
    columns = sorted(frame.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=key)
    result = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in result.description]
    theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)
    assert len(ours) == len(theirs)
    assert all(_same(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


def shingles(text, words):
    found = re.findall(SPACES, (text or "").translate({n: n + 32 for n in range(65, 91)}))
    if not found:
        return set()
    return {tuple(found[n : n + words]) for n in range(max(len(found) - words + 1, 1))}


def linked(sets, percent):
    """Smallest id reachable, by all pairs."""
    root = {n: n for n in sets}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {n: find(n) for n in ids}


def test_op2(spark, documents):
    sets = {d: shingles(t, 3) for d, t, _ in documents}
    components = linked(sets, 90)
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in catalog.op2_ngram_jaccard(spark, DIRECTORY).collect()}
    assert got == {(d, len(sets[d]), components[d]) for d in sets}


def test_op3(spark, documents):
    index = license_scan.build_index()
    expected = sorted((d, *m) for d, t, _ in documents for m in brute_licenses(index, t or ""))
    got = sorted((r.doc_id, r.license, r.matched_words) for r in catalog.op3_license_scan(spark, DIRECTORY).collect())
    assert got == expected


def brute_licenses(index, text):
    """(name, matched words) of the best alignments with whole texts, without bands, regions or fingerprints."""
    numbers = [index.words.get(w, 0) for w in license_scan.WORD.findall(text.encode().lower())]
    found = []
    for name, own in zip(index.names, index.templates, strict=True):
        own, rest = own.tolist(), [(0, len(numbers))]
        while rest:
            low, high = rest.pop()
            words = numbers[low:high]
            common = sum((collections.Counter(own) & collections.Counter(w for w in words if w)).values())
            if common < 0.8 * len(own):
                continue
            matched, first, last = plain_align(own, words)
            if matched >= 0.8 * len(own):
                found.append((name, matched))
            if matched:
                rest += [(low, low + first), (low + last + 1, high)]
    return found


def plain_align(template, words):
    """Best local alignment with 2 for a match, -1 for a change or a gap: matched words, first and last word."""
    score = [[0] * (len(words) + 1) for _ in range(len(template) + 1)]
    best, at = 0, (0, 0)
    for i, t in enumerate(template, start=1):
        above, row = score[i - 1], score[i]
        for j, w in enumerate(words, start=1):
            row[j] = max(0, above[j - 1] + (2 if t == w else -1), above[j] - 1, row[j - 1] - 1)
            if row[j] > best:
                best, at = row[j], (i, j)
    (i, j), places = at, []
    while i and j and score[i][j]:
        same = template[i - 1] == words[j - 1]
        if score[i][j] == score[i - 1][j - 1] + (2 if same else -1):
            places += [j - 1] * same
            i, j = i - 1, j - 1
        elif score[i][j] == score[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return (len(places), places[-1], places[0]) if places else (0, -1, -1)


def test_op4(spark, documents):
    rows = {r.doc_id: r for r in catalog.op4_language_id(spark, DIRECTORY).collect()}
    assert len(rows) == len(documents)
    right, total = 0, 0
    for d, text, lang in documents:
        assert rows[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
        assert 0 <= rows[d].score <= 1
        if rows[d].held_out and lang:
            right, total = right + (rows[d].lang_pred == lang), total + 1
    assert right >= 0.95 * total


def test_op8(spark, documents):
    pieces = sentencepiece_codec.load_pieces()
    rows = {r.doc_id: r for r in catalog.op8_sentencepiece(spark, DIRECTORY).collect()}
    assert len(rows) == len(documents)
    for d, text, _ in documents:
        raw = (text or "").encode()
        assert rows[d].lossless and rows[d].decoded_sha256 == hashlib.sha256(raw).hexdigest()
        assert sentencepiece_codec.decode_ids(pieces, rows[d].ids) == raw
    again = {r.doc_id: r.ids for r in catalog.op8_sentencepiece(spark, DIRECTORY).collect()}
    assert all(again[d] == rows[d].ids for d in rows)


def test_op9(spark, duck):
    rows = {r.page_id: r for r in catalog.op9_html_text(spark, DIRECTORY).collect()}
    pages = duck.execute("SELECT page_id, html FROM pages").fetchall()
    for page_id, source in pages:
        body = re.search(r"<article>(.*?)(</article>|$)", source, re.S)
        marked = re.sub(r"</?(p|h1)>", "\x01", body[1] if body else "").replace("<br>", " ")
        plain = re.sub(r"<[^>]*>?", "", marked)
        blocks = (" ".join(html_extraction.entities.unescape(b).split()) for b in plain.split("\x01"))
        expected = " ".join(b for b in blocks if b)
        assert rows[page_id].text == expected and rows[page_id].n_chars == len(expected)


def covered(texts, length):
    counts = collections.Counter(t[n : n + length] for t in texts for n in range(len(t) - length + 1))
    for text in texts:
        mask = bytearray(len(text))
        for n in range(len(text) - length + 1):
            if counts[text[n : n + length]] > 1:
                mask[n : n + length] = b"\1" * length
        yield mask


def test_op10(spark, documents):
    rows = {r.doc_id: r for r in catalog.op10_suffix_dedup(spark, DIRECTORY).collect()}
    raw = [(t or "").encode() for _, t, _ in documents]
    for (d, _, _), text, mask in zip(documents, raw, covered(raw, 200), strict=True):
        kept = bytes(b for b, gone in zip(text, mask, strict=True) if not gone)
        spans = len(re.findall(rb"\x01+", bytes(mask)))
        got = rows[d]
        assert (got.n_bytes, got.n_removed, got.n_spans) == (len(text), sum(mask), spans)
        assert got.kept_sha256 == hashlib.sha256(kept).hexdigest()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_personal(text):
    """(start, kind number, end) straight from the definition."""
    found = []
    for n, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c in "0123456789"]
            total = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
            fine = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), n, m.end()))
    return sorted(found)


def test_op11(spark, documents):
    rows = {r.doc_id: r for r in catalog.op11_pii(spark, DIRECTORY).collect()}
    assert len(rows) == len(documents)
    kinds = list(BASE)
    for d, text, _ in documents:
        base, got = plain_personal(text or ""), rows[d]
        spans = [f"{kinds[k]}:{a}:{b}" for a, k, b in base]
        assert [got.n_email, got.n_ip, got.n_card, got.n_phone] == [sum(s[1] == n for s in base) for n in range(4)]
        assert got.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        everything = got.spans.split(",") if got.spans else []
        assert set(spans) <= set(everything) and len(everything) == len(spans) + got.n_added


def test_pipeline(spark, documents):
    """Each stage against a plain version on its own input; the stages hand on what they keep."""
    docs = spark.read.parquet(f"{DIRECTORY}/documents.parquet")
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    kept = spark.createDataFrame(stages["language_id"](spark, docs, DIRECTORY).collect(), docs.schema)
    assert kept.columns == names and kept.count() >= 0.98 * len(documents)
    unique = spark.createDataFrame(stages["exact_dedup"](spark, kept, DIRECTORY).collect(), docs.schema)
    best = {}
    for r in kept.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(best.values())
    far = spark.createDataFrame(stages["ngram_jaccard"](spark, unique, DIRECTORY).collect(), docs.schema)
    components = linked({r.doc_id: shingles(r.text, 5) for r in unique.collect()}, 80)
    assert sorted(r.doc_id for r in far.collect()) == sorted(set(components.values()))
    mixed = spark.createDataFrame(stages["source_mixing"](spark, far, DIRECTORY).collect(), docs.schema)
    taken = {r.doc_id: r.times for r in catalog.mixing.mix(far).collect()}
    assert collections.Counter(r.doc_id for r in mixed.collect()) == {d: n for d, n in taken.items() if n}
    coded = stages["sentencepiece"](spark, mixed, DIRECTORY).collect()
    assert len(coded) == mixed.count() and all(r.lossless for r in coded)
