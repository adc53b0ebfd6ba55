"""Licence scan: winnowed fingerprints pick candidates, banded alignment measures them.

The fingerprints of all templates are an inverted index of bounded size that every task has. A text's own winnowed
grams are looked up in it; hits of a template near each other make a candidate region, which is aligned with the template
inside a band around the diagonals of the hits. Texts are independent, so nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections import defaultdict
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import mix64, pieces
from ragloom.llm.license_texts import TEMPLATES

WORD = re.compile(rb"[a-z0-9]+")
#: Words of a fingerprint, and fingerprints of which the smallest is kept: a run of GRAM + WINNOW - 1 common words meets.
GRAM = 3
WINNOW = 2
#: Templates below these lengths have all their fingerprints in the index, the shortest ones those of two words: with four
#: fifths of its words a template of n words keeps a run of four from 20 words on, of three from 6 on, and of two before.
WINNOWED, PAIRED = 20, 10
#: Diagonals on both sides of those of the hits.
BAND = 12
MIN_COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
PART_BYTES = 1 << 20
PIECE_BYTES = 1 << 20
NEVER = np.uint64(2**64 - 1)


@dataclass
class Index:
    """Word numbers (from 1), the words of each template, and fingerprint -> (template, position)."""

    names: list[str]
    words: dict[bytes, int]
    templates: list[np.ndarray]
    keys: np.ndarray
    places: dict[int, list[tuple[int, int]]]
    longest: int


def _grams(numbers: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of all runs of `size` words; runs with a word that no template has (0) get NEVER."""
    count = len(numbers) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    value, known = np.full(count, size, np.uint64), np.ones(count, bool)
    for j in range(size):
        part = numbers[j : j + count]
        value = mix64(value + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        known &= part > 0
    return np.where(known, value >> np.uint64(1), NEVER)


def winnow(grams: np.ndarray) -> np.ndarray:
    """Positions whose hash is the smallest of some window of WINNOW neighbours."""
    if len(grams) <= WINNOW:
        return np.flatnonzero((grams == grams.min()) & (grams != NEVER)) if len(grams) else np.zeros(0, np.int64)
    count = len(grams) - WINNOW + 1
    least = grams[:count]
    for j in range(1, WINNOW):
        least = np.minimum(least, grams[j : j + count])
    kept = np.zeros(len(grams), bool)
    for j in range(WINNOW):
        kept[j : j + len(least)] |= grams[j : j + len(least)] == least
    return np.flatnonzero(kept & (grams != NEVER))


def build_index(templates: Mapping[str, str] = TEMPLATES) -> Index:
    split = {name: WORD.findall(text.encode().lower()) for name, text in templates.items()}
    words = {w: n + 1 for n, w in enumerate(sorted({w for ws in split.values() for w in ws}))}
    numbers = [np.array([words[w] for w in ws], np.int64) for ws in split.values()]
    places: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for t, ids in enumerate(numbers):
        grams = _grams(ids, GRAM if len(ids) >= PAIRED else 2)
        for at in winnow(grams).tolist() if len(ids) >= WINNOWED else range(len(grams)):
            places[int(grams[at])].append((t, at))
    keys = np.array(sorted(places), np.uint64)
    return Index(list(split), words, numbers, keys, dict(places), max(map(len, numbers)))


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best local alignment of the template with the text inside the band: score, matched words, first and last word.

    Row i of the band holds the text positions i + diagonal - band .. i + diagonal + band.
    """
    width = 2 * band + 1
    offsets = np.arange(width)
    score = np.zeros((len(template) + 1, width), np.int32)
    for i, word in enumerate(template.tolist()):
        at = i + diagonal - band + offsets
        inside = (at >= 0) & (at < len(text))
        same = inside & (text[np.where(inside, at, 0)] == word)
        row = score[i] + np.where(same, MATCH, MISMATCH)
        row[:-1] = np.maximum(row[:-1], score[i, 1:] + GAP)
        row = np.maximum(np.where(inside, row, 0), 0)
        score[i + 1] = np.maximum.accumulate(row - GAP * offsets) + GAP * offsets
    i, b = np.unravel_index(int(score.argmax()), score.shape)
    best, matched, first, last = int(score[i, b]), 0, -1, -1
    while i > 0 and score[i, b] > 0:
        at = int(i) - 1 + diagonal - band + int(b)
        same = 0 <= at < len(text) and text[at] == template[i - 1]
        if score[i, b] == score[i - 1, b] + (MATCH if same else MISMATCH):
            if same:
                matched, first, last = matched + 1, at, at if last < 0 else last
            i -= 1
        elif b + 1 < width and score[i, b] == score[i - 1, b + 1] + GAP:
            i, b = i - 1, b + 1
        elif b > 0 and score[i, b] == score[i, b - 1] + GAP:
            b -= 1
        else:
            break
    return best, matched, first, last


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words that two runs of words have in common, repeats counted; 0 is no word."""
    size = int(max(a.max(initial=0), b.max(initial=0))) + 1
    return int(np.minimum(np.bincount(a, minlength=size), np.bincount(b, minlength=size))[1:].sum())


def _regions(hits: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces of the text with hits (text position, template position): first and last word, diagonal and half width.

    What a match skips costs one a word and what it matches brings two, so it spans less than three times its template.
    Pieces of six lengths, three apart, hold every match whole; the band covers the diagonals of all hits in the piece.
    """
    reach = 3 * length
    pieces_: dict[int, list[int]] = defaultdict(list)
    for d, t in hits:
        for n in {d // reach, max(d // reach - 1, 0)}:
            pieces_[n].append(d - t)
    for n, diagonals in pieces_.items():
        low, high = min(diagonals), max(diagonals)
        yield n * reach, (n + 2) * reach, (low + high) // 2, (high - low + 1) // 2 + BAND


def _alignments(
    template: np.ndarray, text: np.ndarray, region: tuple[int, int, int, int], least: float
) -> Iterator[tuple[int, int, int]]:
    """All matches in the region that don't overlap, with at least `least` words: matched words, first and last word.

    The best alignment cuts the text in two; what lies before and after it is aligned again while enough words are common.
    """
    start, end, diagonal, band = region
    rest = [(start, min(end, len(text)))]
    while rest:
        low, high = rest.pop()
        near = text[low:high]
        if low >= high or _common(near, template) < least:  # no alignment here can match enough words
            continue
        _, matched, first, last = align(template, near, diagonal - low, band)
        if not matched:
            continue
        if matched >= least:
            yield matched, low + first, low + last
        rest += [(low, low + first), (low + last + 1, high)]


def _characters(raw: bytes, places: set[int]) -> dict[int, int]:
    """How many characters of UTF-8 lie before each byte position."""
    data, found, count, at = np.frombuffer(raw, np.uint8), {}, 0, 0
    for place in sorted(places):
        count, at = count + int(np.count_nonzero((data[at:place] & 0xC0) != 0x80)), place
        found[place] = count
    return found


def scan_text(index: Index, text: str, min_coverage: float = MIN_COVERAGE) -> list[tuple[str, int, int, int, float]]:
    """Matches (template, start, end, matched words, coverage) in one text; offsets count characters."""
    lowered = text.encode("utf-8", "surrogatepass").lower()  # of bytes, A-Z only
    found: set[tuple[int, int, int, int]] = set()
    start = 0
    while True:
        part = lowered[start : start + PART_BYTES]
        found |= {(t, a + start, b + start, m) for t, a, b, m in _scan_part(index, part, min_coverage)}
        if start + PART_BYTES >= len(lowered):
            break
        # The next part repeats more than any match can span.
        back = lowered.rfind(b" ", start, start + PART_BYTES - 16 * 3 * (index.longest + BAND))
        start = back if back > start else start + PART_BYTES // 2
    best: list[tuple[int, int, int, int]] = []
    kept: list[tuple[int, int]] = []  # spans of the same template, by position
    for one in sorted(found, key=lambda x: (x[0], -x[3], x[2] - x[1], x[1])):
        if best and best[-1][0] != one[0]:
            kept = []
        at = bisect(kept, one[1:3])
        if (at == 0 or kept[at - 1][1] <= one[1]) and (at == len(kept) or one[2] <= kept[at][0]):
            kept.insert(at, one[1:3])
            best.append(one)
    chars = _characters(lowered, {at for one in best for at in one[1:3]})
    return sorted((index.names[t], chars[a], chars[b], m, m / len(index.templates[t])) for t, a, b, m in best)


def _scan_part(index: Index, text: bytes, min_coverage: float) -> Iterator[tuple[int, int, int, int]]:
    get = index.words.get
    words = WORD.findall(text)
    numbers = np.array([get(w, 0) for w in words], np.int64)
    if np.count_nonzero(numbers) < 2 or not len(index.keys):
        return
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size in (2, GRAM):
        grams = _grams(numbers, size)
        at = np.flatnonzero(grams != NEVER)
        place = np.minimum(np.searchsorted(index.keys, grams[at]), len(index.keys) - 1)
        for position in at[index.keys[place] == grams[at]].tolist():
            for template, place_ in index.places[int(grams[position])]:
                hits[template].append((position, place_))
    spans = None
    for template, places in hits.items():
        own = index.templates[template]
        for region in _regions(places, len(own)):
            for matched, first, last in _alignments(own, numbers, region, min_coverage * len(own)):
                spans = spans or [m.span() for m in WORD.finditer(text)]
                yield template, spans[first][0], spans[last][1], matched


def scan(
    documents: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    min_coverage: float = MIN_COVERAGE,
    id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per match: doc_id, license, span_start, span_end (characters), matched_words, coverage.

    A match has at least `min_coverage` of the template's words in order, and skips or changes at most half as many words
    as it matches twice over (an alignment with 2 for a match, -1 for a word skipped or changed). Case and punctuation
    don't count; letters other than A-Z separate words. A template that is repeated gives a match each time; of overlapping matches of one
    template, that with most words (then the shortest) is reported. Null and empty texts have none; every row is scanned on its own, so repeated ids and texts give repeated matches.
    """
    index = build_index(templates)
    sent = documents.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = sent.schema["doc_id"]
    schema = T.StructType([
        kind, T.StructField("license", T.StringType()), T.StructField("span_start", T.LongType()),
        T.StructField("span_end", T.LongType()), T.StructField("matched_words", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
    ])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                rows, matches = [], []
                for n, one in enumerate(batch.column("text").to_pylist()):
                    for match in scan_text(index, one, min_coverage):
                        rows.append(n)
                        matches.append(match)
                if rows:
                    columns = list(zip(*matches, strict=True))
                    ids = batch.column("doc_id").take(pa.array(rows))
                    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays(
                        [ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names
                    )

    return sent.mapInArrow(run, schema)
