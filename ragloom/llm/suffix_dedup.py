"""Removal of repeated passages: every byte inside a string of a given length that also starts elsewhere.

Inside a task the work is a Burrows-Wheeler transform of a block of text. Intervals of suffixes are extended backward,
breadth first, one letter a level; a level closes the borders between suffixes whose common prefix has that length, so
common prefixes come out by increasing value. The search stops at the minimum length: suffixes with no border between
them by then share at least that much.

Texts are dealt to blocks so that equal strings always meet. A window of the minimum length is known by the smallest
hash of the k-grams inside; equal windows have equal ones. Neighbouring windows with the same hash are one segment. A
hash that no other segment has needs no work, equal segments are repeats as a whole, and only segments that share a hash
and differ go to blocks, one copy of each. Where very many different segments share a hash, they are cut anew by longer
k-grams, down to whole windows if need be, so that no block grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ragloom.llm.common import Scratch, buffers, mix64, pieces

LENGTH = 200
GRAM = 64
BASE = np.uint64(0x9E3779B97F4A7C15)
PIECE_BYTES = 1 << 20
#: Bytes of a block, and of the different segments of one hash that are searched in a block.
BLOCK_BYTES = 1 << 20
HASH_BYTES = BLOCK_BYTES
#: Records of one hash that are looked at together.
HELD_RECORDS = 1 << 20
SYMBOL_BITS = 9


# ---- segments ------------------------------------------------------------------------------------------------------


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2^64."""

    def __init__(self, base: np.uint64):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.base, self.inverse, self.size = base, inverse, 0
        self.up = self.down = np.zeros(0, np.uint64)

    def grow(self, size: int) -> None:
        if size > self.size:
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))
            self.size = size


_POWERS = _Powers(BASE)


def _prefix(text: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; `_span` gives the hash of any part."""
    _POWERS.grow(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(text)], out=sums[1:])
    return sums


def _span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * _POWERS.down[start])


def _sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """Minimum or maximum of each `width` neighbours: running ones from both ends of blocks of that width."""
    count = len(values) - width + 1
    blocks = -(-len(values) // width)
    fill = values[-1]
    padded = np.full(blocks * width, fill, values.dtype)
    padded[: len(values)] = values
    square = padded.reshape(blocks, width)
    ahead = pick.accumulate(square, axis=1).reshape(-1)
    behind = pick.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(behind[:count], ahead[width - 1 : width - 1 + count])


def segments(text: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Segments of the joined texts: row, start in the text, windows, hash, hash of the content, repeats inside.

    A segment is a run of neighbouring windows of one text whose smallest k-gram hash is equal.
    """
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    total = len(text)
    if total < length:
        return empty
    sums = _prefix(text)
    at = np.arange(total - gram + 1)
    grams = _span(sums, at, at + gram)
    least = _sliding(grams, length - gram + 1, np.minimum)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first = np.arange(len(least))
    whole = row[first] == row[first + length - 1]
    if not whole.any():
        return empty
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (row[first[1:]] != row[first[:-1]]) | (whole[1:] != whole[:-1])
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(least))
    keep = whole[starts]
    starts, ends = starts[keep], ends[keep]
    # A position is chosen if some window that has it has its hash as the smallest; two chosen positions with one hash
    # in a segment mean that the segment may repeat itself.
    span = length - gram + 1
    wide = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero(_sliding(wide, span, np.maximum)[: len(grams)] == grams)
    twice = np.flatnonzero((grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= span))
    inside = np.zeros(len(starts), bool)
    if len(twice):
        left, right = chosen[twice], chosen[twice + 1]
        # The segment of the first position begins less than one window before it, or is the last that begins earlier.
        # Marking a segment that doesn't repeat itself only costs work.
        low = np.searchsorted(starts, np.maximum(left - span + 1, 0), side="left")
        of = np.searchsorted(starts, left, side="right") - 1
        for step in range(-1, int((of - low).max(initial=0)) + 1):
            n = np.clip(low + step, 0, len(starts) - 1)
            hit = (starts[n] <= right) & (ends[n] + length - gram > left) & (least[starts[n]] == grams[left])
            inside[n[hit]] = True
    content = _span(sums, starts, ends + length - 1) ^ (ends - starts).astype(np.uint64)
    return row[starts], starts - offsets[row[starts]], ends - starts, least[starts], mix64(content), inside


def _pack(start: np.ndarray, windows: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return (start << 25) | (windows << 1) | inside


def _records(length: int, gram: int):
    """A record per segment: hash, content, doc_id, th, place (start, windows and whether it may repeat itself)."""
    names = ["hash", "content", "doc_id", "th", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                data, offsets = buffers(batch.column("text"))
                low, high = int(offsets[0]), int(offsets[-1])
                # A text of more than a piece is cut into parts that share all but one byte of a window.
                step = 2 * PIECE_BYTES if batch.num_rows == 1 else high - low
                for start in range(low, max(high - length + 1, low + 1), max(step, 1)):
                    end = min(start + step + length - 1, high)
                    cuts = np.array([0, end - start]) if batch.num_rows == 1 else offsets - low
                    row, at, windows, least, content, inside = segments(data[start:end], cuts, length, gram)
                    if not len(row):
                        continue
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(least.view(np.int64)), pa.array(content.view(np.int64)),
                            batch.column("doc_id").take(take), batch.column("th").take(take),
                            pa.array(_pack(at + (start - low), windows, inside)),
                        ],
                        names,
                    )

    return run


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From records sorted by (hash, content), column `kind`: 0 repeated as a whole; to be searched: 1 unknown, 2 repeated
    already, for the others to be compared with. Records that come with a kind are 1 or 2.
    """

    def judged(table: pa.Table, mixed: bool) -> pa.RecordBatch | None:
        """All records of some hashes; `mixed` if more of the (only) hash is elsewhere."""
        key, content = table.column("hash").to_numpy(), table.column("content").to_numpy()
        place = table.column("place").to_numpy()
        new_key = np.append(True, key[1:] != key[:-1])
        new = new_key | np.append(True, content[1:] != content[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        group = np.cumsum(new_key[starts]) - 1
        search = np.bincount(group) > 1
        search |= np.bincount(group, weights=place[starts] & 1) > 0
        searched = search[group] | mixed
        own = table.column("kind").to_numpy() == 2 if "kind" in table.column_names else np.zeros(len(key), bool)
        covered = np.flatnonzero(np.repeat(sizes > 1, sizes) & ~own)
        known = (sizes > 1) | own[starts]
        asked = starts[searched]
        rows = np.concatenate([covered, asked])
        if not len(rows):
            return None
        kind = np.concatenate([np.zeros(len(covered), np.int8), np.where(known[searched], 2, 1).astype(np.int8)])
        taken = table.take(pa.array(rows)).combine_chunks()
        taken = taken.drop_columns(["kind"]) if "kind" in taken.column_names else taken
        return taken.append_column("kind", pa.array(kind)).to_batches()[0]

    held: pa.Table | None = None
    open_key = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not held.num_rows:
            continue
        key = held.column("hash").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if open_key is not None:
            end = int(np.searchsorted(key, open_key, side="right"))
            if end < len(key):
                if end and (out := judged(held.slice(0, end), True)) is not None:
                    yield out
                held, last, open_key = held.slice(end), last - end, None
        if last > 0 and (out := judged(held.slice(0, last), False)) is not None:
            yield out
        held = held.slice(max(last, 0))
        if held.num_rows > HELD_RECORDS:
            content = held.column("content").to_numpy()
            cut = int(np.searchsorted(content, content[-1])) or held.num_rows - 1
            if (out := judged(held.slice(0, cut), True)) is not None:
                yield out
            held, open_key = held.slice(cut).combine_chunks(), held.column("hash")[-1].as_py()
    if held is not None and held.num_rows and (out := judged(held, open_key is not None)) is not None:
        yield out


# ---- blocks --------------------------------------------------------------------------------------------------------


def _suffix_order(text: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in order of at least their first `depth` letters. 0 ends a segment; `left`: letters up to the end."""
    size, packed = len(text), 63 // SYMBOL_BITS
    key, alive = np.zeros(size, np.int64), np.ones(size, bool)
    for j in range(packed):
        letter = np.zeros(size, np.int64)
        letter[: size - j] = text[j:]
        letter[~alive] = 0
        key = (key << SYMBOL_BITS) | letter
        alive &= letter > 0
    known = packed
    while True:
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(size, np.int64)
        rank[order] = np.cumsum(np.append(False, ordered[1:] != ordered[:-1]))
        if known >= depth:
            return order
        behind = np.zeros(size, np.int64)
        far = np.flatnonzero(left >= known)
        behind[far] = rank[far + known] + 1
        key, known = rank * (size + 1) + behind, 2 * known


def repeated_starts(text: np.ndarray, length: int) -> np.ndarray:
    """True where a string of `length` letters starts that starts elsewhere too. `text` ends each segment with 0.

    Breadth-first backward extension on the Burrows-Wheeler transform. The interval of a string holds the suffixes that
    start with it; the rows of a letter inside it, taken through the LF mapping, are the interval of that letter and the
    string. A string of n letters whose interval ends at a border that is still open closes it: the common prefix there
    has n - 1 letters. Other intervals need not be extended.
    """
    size = len(text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(size))] - np.arange(size)
    order = _suffix_order(text, left, length + 1)
    last = text[order - 1]  # the letter before each suffix; before the first one stands the last end
    by_letter = np.argsort(last, kind="stable")
    mapped = np.empty(size, np.int64)
    mapped[by_letter] = np.arange(size)
    closed = np.zeros(size + 1, bool)
    closed[0] = True
    counts = np.bincount(text)
    high = np.cumsum(counts)[counts > 0]
    low = high - counts[counts > 0]
    closed[high] = True
    for _ in range(length - 1):
        if not len(low):
            break
        single = high - low == 1
        rows = low[single]
        rows = rows[last[rows] > 0]
        new_low, new_high = [mapped[rows]], [mapped[rows] + 1]
        if not single.all():
            start, sizes = low[~single], (high - low)[~single]
            number = np.repeat(np.arange(len(start)), sizes)
            rows = np.arange(len(number)) + np.repeat(start - (np.cumsum(sizes) - sizes), sizes)
            letter = last[rows]
            real = letter > 0
            rows, group = rows[real], (number[real] << SYMBOL_BITS) | letter[real]
            by_group = np.argsort(group, kind="stable")
            rows, group = rows[by_group], group[by_group]
            heads = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
            tails = np.append(heads[1:], len(group)) - 1
            new_low.append(mapped[rows[heads]])
            new_high.append(mapped[rows[tails]] + 1 if len(heads) else np.zeros(0, np.int64))
        low, high = np.concatenate(new_low), np.concatenate(new_high)
        still = ~closed[high]
        low, high = low[still], high[still]
        closed[high] = True
    again = ~(closed[:-1] & closed[1:])
    found = np.zeros(size, bool)
    found[order[again]] = True
    return found & (left >= length)


def _search_block(rows: list[dict], length: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, bytes) of repeated parts of the unknown segments of a block."""
    parts = [np.frombuffer(r["bytes"], np.uint8) for r in rows]
    sizes = np.array([len(p) + 1 for p in parts])
    first = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int64)
    for at, part in zip(first.tolist(), parts, strict=True):
        text[at : at + len(part)] = part
        text[at : at + len(part)] += 1
    found = repeated_starts(text, length)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
    begins, ends = edge[::2], edge[1::2]
    of = np.searchsorted(first, begins, side="right") - 1
    for n, begin, end in zip(of.tolist(), begins.tolist(), ends.tolist(), strict=True):
        if rows[n]["kind"] == 1:
            yield n, begin - int(first[n]), end - begin + length - 1


def _spans_schema(kind: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", kind), T.StructField("th", T.LongType()), T.StructField("start", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ])


def _search(length: int, kind: pa.DataType):
    """Spans of repeated bytes; whole hashes are put into blocks of about BLOCK_BYTES."""
    names = ["doc_id", "th", "start", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        size = 0

        def spans() -> pa.RecordBatch | None:
            if not any(r["kind"] == 1 for r in block):
                return None
            found = [
                (block[n]["doc_id"], block[n]["th"], (block[n]["place"] >> 25) + start, count)
                for n, start, count in _search_block(block, length)
            ]
            if not found:
                return None
            types = (kind, pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names
            )

        for batch in batches:
            for row in batch.to_pylist():
                if size >= BLOCK_BYTES and row["hash"] != block[-1]["hash"]:
                    if (out := spans()) is not None:
                        yield out
                    block, size = [], 0
                block.append(row)
                size += len(row["bytes"])
        if block and (out := spans()) is not None:
            yield out

    return run


def _cut(length: int):
    """The bytes of the segments that are asked for, from each text."""
    names = ["hash", "doc_id", "th", "place", "kind", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                data, offsets = buffers(batch.column("text"))
                asked = batch.column("asked")
                row = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
                flat = asked.flatten()
                place = flat.field("place").to_numpy()
                start = offsets[row] + (place >> 25)
                end = start + ((place >> 1) & ((1 << 24) - 1)) + length - 1
                for low in range(0, len(row), 4_096):
                    part = slice(low, low + 4_096)
                    take = pa.array(row[part])
                    bytes_ = [data[a:b].tobytes() for a, b in zip(start[part].tolist(), end[part].tolist(), strict=True)]
                    rows = flat.slice(low, 4_096)
                    yield pa.RecordBatch.from_arrays(
                        [
                            rows.field("hash"), batch.column("doc_id").take(take), batch.column("th").take(take),
                            rows.field("place"), rows.field("kind"), pa.array(bytes_, pa.binary()),
                        ],
                        names,
                    )

    return run


def _resegment(length: int, gram: int):
    """Cut segments anew by longer k-grams: records as `_records` gives, with the kind and the bytes they have."""
    names = ["hash", "content", "doc_id", "th", "place", "kind", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "bytes", PIECE_BYTES):
                data, offsets = buffers(batch.column("bytes"))
                text, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
                row, at, windows, least, content, inside = segments(text, offsets, length, gram)
                take = pa.array(row)
                outer = batch.column("hash").to_numpy().view(np.uint64)[row]
                start = offsets[row] + at
                end = start + windows + length - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mix64(outer + least).view(np.int64)), pa.array(content.view(np.int64)),
                        batch.column("doc_id").take(take), batch.column("th").take(take),
                        pa.array(_pack((batch.column("place").to_numpy() >> 25)[row] + at, windows, inside)),
                        batch.column("kind").take(take),
                        pa.array([text[x:y].tobytes() for x, y in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()),
                    ],
                    names,
                )

    return run


# ---- the operator --------------------------------------------------------------------------------------------------


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def repeated_spans(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, th, start, bytes): parts of texts, overlapping ones too, inside strings that also start elsewhere.

    `documents` has doc_id, th (a hash of the text) and text (binary). Rows that repeat doc_id and text are repeats of
    each other and share their spans.
    """
    scratch = Scratch(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType
    id_type = kind.simpleString()
    record = f"hash long, content long, doc_id {id_type}, th long, place long"
    records = documents.mapInArrow(_records(length, gram), record)
    dealt = records.repartition("hash").sortWithinPartitions("hash", "content")
    judged = scratch.write("judged", dealt.mapInArrow(_classify, f"{record}, kind byte"))
    covered = _whole(judged.filter("kind = 0"), length)
    # One copy of each segment that is asked about, with its bytes.
    asked = judged.filter("kind > 0").groupBy("doc_id", "th").agg(
        F.collect_list(F.struct("hash", "place", "kind")).alias("asked")
    ).withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    texts = documents.join(asked.hint("merge"), same).select("doc_id", "th", "text", "asked")
    searched = scratch.write("searched", texts.mapInArrow(
        _cut(length), f"hash long, doc_id {id_type}, th long, place long, kind byte, bytes binary"
    ).dropDuplicates(["hash", "doc_id", "th", "place"]))
    parts = [covered]
    # A hash with many different segments is cut anew by longer k-grams, which fewer of them share, down to whole
    # windows; so what blocks have to hold doesn't grow with the corpus.
    for step, span in enumerate(((length - gram) // 4, (length - gram) // 16, 0)):
        sizes = searched.groupBy("hash").agg(F.sum(F.octet_length("bytes")).alias("n"))
        many = scratch.write(f"many{step}", sizes.filter(F.col("n") > HASH_BYTES).select("hash"))
        few = searched.join(many, "hash", "left_anti").repartition("hash").sortWithinPartitions("hash")
        parts.append(few.mapInArrow(_search(length, to_arrow_type(kind)), _spans_schema(kind)))
        if many.isEmpty():
            break
        finer = searched.join(many, "hash", "left_semi").mapInArrow(
            _resegment(length, length - span), f"{record}, kind byte, bytes binary"
        )
        dealt = finer.repartition("hash").sortWithinPartitions("hash", "content")
        judged = scratch.write(f"finer{step}", dealt.mapInArrow(_classify, f"{record}, bytes binary, kind byte"))
        # Segments of whole windows that share a hash are equal, but for how often they repeat themselves.
        parts.append(_whole(judged.filter("kind < 2" if span == 0 else "kind = 0"), length))
        searched = judged.filter("kind > 0")
    spans = parts[0]
    for part in parts[1:]:
        spans = spans.unionByName(part)
    spans = scratch.write("spans", spans)
    scratch.drop(*[name for name in scratch.paths if name != "spans"])
    return spans


def _whole(records: DataFrame, length: int) -> DataFrame:
    """The spans of segments that are repeated as a whole."""
    windows = F.shiftright(F.col("place").bitwiseAND(F.lit((1 << 25) - 1)), 1)
    return records.select(
        "doc_id", "th", F.shiftright("place", 25).alias("start"), (windows + F.lit(length - 1)).cast("long").alias("bytes")
    )


def _remove(kept: list[str]):
    names = [*kept, "n_bytes", "n_removed", "n_spans", "kept_bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", PIECE_BYTES):
                texts, spans = batch.column("text"), batch.column("spans")
                removed, runs, rest = [], [], []
                for n in range(batch.num_rows):
                    text = texts[n].as_py()
                    parts, at, gone, count, end = [], 0, 0, 0, -1
                    for one in sorted((s["start"], s["start"] + s["bytes"]) for s in (spans[n].as_py() or ())):
                        if one[0] > end:
                            parts.append(text[at : one[0]])
                            count += 1
                            gone += one[1] - one[0]
                            end = at = one[1]
                        elif one[1] > end:
                            gone += one[1] - end
                            end = at = one[1]
                    parts.append(text[at:])
                    removed.append(gone)
                    runs.append(count)
                    rest.append(b"".join(parts))
                sizes = pa.array([len(texts[n].as_py()) for n in range(batch.num_rows)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(c) for c in kept], sizes, pa.array(removed, pa.int64()), pa.array(runs, pa.int64()),
                        pa.array(rest, pa.binary()),
                    ],
                    names,
                )

    return run


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_bytes, kept_sha256.

    Texts count as UTF-8 bytes. Each byte covered by a string of `length` bytes that also starts anywhere else, in the
    same text or another, is removed; n_spans counts maximal removed runs, kept_bytes has the remaining bytes. Null and
    empty texts, and texts below `length` bytes, lose nothing. Rows that repeat a text of at least `length` bytes lose
    all of it. Null ids are ids like others. An empty table gives no rows.
    """
    sent = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text")
    ).withColumn("th", _text_hash(F.col("text")))
    spans = repeated_spans(sent, length, gram)
    by_text = spans.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "bytes")).alias("spans"))
    by_text = by_text.withColumnRenamed("doc_id", "_id").withColumnRenamed("th", "_th")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th"))
    rows = sent.join(by_text.hint("merge"), same, "left").select("doc_id", "text", "spans")
    kind = sent.schema["doc_id"]
    schema = T.StructType([
        kind, *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
        T.StructField("kept_bytes", T.BinaryType()),
    ])
    done = rows.mapInArrow(_remove(["doc_id"]), schema)
    return done.withColumn("kept_sha256", F.sha2("kept_bytes", 256))

