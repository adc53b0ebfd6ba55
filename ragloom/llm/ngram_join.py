"""Near-duplicate documents by the Jaccard similarity of their word n-grams, found with R-trees over count vectors.

The n-grams of a document are hashed into GROUPS groups; their counts are a point. Two documents share at most the sum
of the smaller of their counts, coordinate by coordinate, and the same sum over the maximum corners of two bounding boxes
bounds all pairs below them. So an R-tree over points finds all pairs that can be similar, and sets verify them.

One tree can't hold a corpus, so points are dealt to many: each document goes to the trees of its rarest n-grams, as
many as it may lack in a partner plus one. Documents that are similar enough meet in one of them for certain. Trees with
equal members are built once, large ones are cut into blocks, and pairs that are in one component already are not tested
again, which keeps a group of near copies linear. No pair is given up: the last round tests all that is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ragloom.functions.scale import small_batches
from ragloom.llm.common import HOT_SHARE, Scratch, components, join_groups, mix64, packed, pieces, tidy

GROUPS = 256
LEAF = 32
#: Members of a tree that are searched together; a larger one is cut into blocks of this size that meet in pairs.
BLOCK = 2_048
#: Groups for the frequency of n-grams, which orders them from rare to frequent, and the parts they are summed in.
FREQUENCY_GROUPS = 1 << 18
FREQUENCY_PARTS = 64
LANES = 256
#: Bits of the filter that tells which sets are needed; more sets than bits only make it let more through.
FILTER_BITS = 1 << 26
#: Trees with more members than this are not compared with others by their members.
SIGNED_MEMBERS = 1 << 20
CACHED_WORDS = 100_000
PIECE_BYTES = 2 << 20
PART_BYTES = 4 << 20


class _Hashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _word_hashes(text: bytes, cache: _Hashes) -> np.ndarray:
    """Hashes of the lower-cased words of a text; bytes.lower changes A-Z only, bytes.split cuts at \\x20 and \\x09-\\x0D."""
    found, start = [], 0
    while start < len(text):
        end = start + PART_BYTES
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        words = text[start:end].lower().split()
        found.append(np.fromiter(map(cache.__getitem__, words), np.uint64, len(words)))
        start = end
    if len(cache) > CACHED_WORDS:
        cache.clear()
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def shingle_set(text: bytes, words: int, cache: _Hashes) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words; with fewer words, of the whole sequence."""
    hashes = _word_hashes(text, cache)
    if not len(hashes):
        return hashes
    count = max(len(hashes) - words + 1, 1)
    width = min(words, len(hashes))
    value = np.full(count, width, np.uint64)
    for j in range(width):
        value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + count])
    value.sort()
    return value[np.append(True, value[1:] != value[:-1])]


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, int]]:
    """Each row's batch, row number, set and the 64-bit number of the set."""
    cache = _Hashes()
    for whole in batches:
        for batch in pieces(whole, "text", PIECE_BYTES):
            for n, text in enumerate(batch.column("text").to_pylist()):
                own = shingle_set(text, words, cache)
                yield batch, n, own, xxhash.xxh3_64_intdigest(own.tobytes()) - (1 << 63) if len(own) else 0


def required(first, second, percent: int):
    """Least number of common n-grams that makes two sets of these sizes similar."""
    return -(-percent * (first + second) // (100 + percent))


def prefix_length(size: int, percent: int) -> int:
    return size + (-percent * size // 100) + 1


# ---- passes over the documents -------------------------------------------------------------------------------------

PROFILES = (
    "doc_id {id}, mark binary, n_shingles long, node long, point binary, excess long, part int, lane int, counts binary"
)


def point_of(own: np.ndarray) -> tuple[bytes, int]:
    """Counts of a set's n-grams by group, at most 255 each, and what is beyond that in all groups together."""
    counts = np.bincount(((own >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS)
    low = np.minimum(counts, 255).astype(np.uint8)
    return low.tobytes(), int((counts - low).sum())


def _profile(words: int, kind: pa.DataType):
    """Per document its set's size, number and point; per task the frequencies of all its n-grams by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counts, ids, marks, sizes, nodes, points = np.zeros(FREQUENCY_GROUPS, np.int64), [], [], [], [], []
        names = ["doc_id", "mark", "n_shingles", "node", "point", "excess", "part", "lane", "counts"]

        def batch_of() -> pa.RecordBatch:
            blank = pa.nulls(len(ids), pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(marks, pa.binary()), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                 pa.array([x for x, _ in points], pa.binary()), pa.array([x for _, x in points], pa.int64()),
                 blank, blank, pa.nulls(len(ids), pa.binary())], names,
            )

        for batch, n, own, node in _sets(batches, words):
            ids.append(batch.column("doc_id")[n].as_py())
            marks.append(batch.column("mark")[n].as_py())
            sizes.append(len(own))
            nodes.append(node)
            points.append(point_of(own))
            np.add.at(counts, (own & np.uint64(FREQUENCY_GROUPS - 1)).astype(np.int64), 1)
            if len(ids) >= 10_000:
                yield batch_of()
                ids, marks, sizes, nodes, points = [], [], [], [], []
        if ids:
            yield batch_of()
        if counts.any():
            number = TaskContext.get().partitionId() % LANES
            parts = [x.tobytes() for x in np.split(counts, FREQUENCY_PARTS)]
            blank = pa.nulls(FREQUENCY_PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(FREQUENCY_PARTS, kind), pa.nulls(FREQUENCY_PARTS, pa.binary()), blank, blank, pa.nulls(FREQUENCY_PARTS, pa.binary()), blank,
                 pa.array(range(FREQUENCY_PARTS), pa.int32()),
                 pa.array([number] * FREQUENCY_PARTS, pa.int32()), pa.array(parts, pa.binary())], names,
            )

    return run


def _summed(keys: list[str], rows: DataFrame) -> DataFrame:
    """Add up the count arrays of each key, one after the other."""

    def add(batches):
        total, first = None, None
        for frame in batches:
            for one in frame["counts"]:
                total = np.frombuffer(one, np.int64) + (0 if total is None else total)
            first = frame[keys].iloc[:1] if first is None else first
        if first is not None:
            yield first.assign(counts=[total.tobytes()])

    fields = ", ".join(f"{k} int" for k in keys)
    shuffled = rows.select(*keys, "counts")

    def each(key, frame):
        return next(add([frame]))

    return shuffled.groupBy(*keys).applyInPandas(each, f"{fields}, counts binary")


def frequencies(profiles: DataFrame) -> np.ndarray:
    """Total count of each frequency group: an array of fixed size, summed in two steps of bounded fan-in."""
    rows = profiles.filter("part IS NOT NULL")
    summed = _summed(["part"], _summed(["part", "lane"], rows))
    out = np.zeros(FREQUENCY_GROUPS, np.int64).reshape(FREQUENCY_PARTS, -1)
    for row in summed.collect():  # FREQUENCY_PARTS rows
        out[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def _postings(words: int, percent: int, order):
    """(cell, n, node, place): each set goes to the cells of its rarest n-grams, of which the cell's is number `place`;
    a task sends each set once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = order.value
        seen: set[int] = set()
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            columns = (np.concatenate(x) for x in zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["cell", "n", "node", "place"])

        for _, _, own, node in _sets(batches, words):
            if not len(own) or node in seen:
                continue
            seen.add(node)
            rank = frequency[(own & np.uint64(FREQUENCY_GROUPS - 1)).astype(np.int64)]
            cell = own[np.lexsort((own, rank))[: prefix_length(len(own), percent)]]
            size, place = np.full(len(cell), len(own), np.int32), np.arange(len(cell), dtype=np.int32)
            rows.append((cell.view(np.int64), size, np.full(len(cell), node, np.int64), place))
            held += len(cell)
            if held >= 100_000:
                yield batch_of()
                rows, held = [], 0
        if rows:
            yield batch_of()

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def _shared_cells(percent: int):
    """From rows sorted by (cell, n, node): the members of each cell that have another of a similar size there, with a
    signature of the members.
    """
    names = ["signature", "node", "place"]

    def rows(cell: np.ndarray, size: np.ndarray, node: np.ndarray, place: np.ndarray, signed: bool) -> pa.RecordBatch | None:
        fresh = np.append(True, (cell[1:] != cell[:-1]) | (node[1:] != node[:-1]))
        cell, size, node, place = cell[fresh], size[fresh].astype(np.int64), node[fresh], place[fresh]
        # Members are in order of size: the next one decides, and the one before.
        close = (cell[1:] == cell[:-1]) & (size[1:] * percent <= size[:-1] * 100)
        keep = np.append(False, close) | np.append(close, False)
        if not keep.any():
            return None
        cell, node, place = cell[keep], node[keep], place[keep]
        starts = _runs(cell)
        sizes = np.diff(starts)
        if signed:
            with np.errstate(over="ignore"):
                sums = np.add.reduceat(mix64(node.view(np.uint64)), starts[:-1])
            mark = np.repeat(mix64(sums + sizes.astype(np.uint64)).view(np.int64), sizes)
        else:
            mark = cell
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (mark, node, place)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, open_run = None, False
        for batch in batches:
            new = [batch.column(n).to_numpy() for n in range(4)]
            now = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            if not len(now[0]):
                continue
            starts = _runs(now[0])
            if open_run and len(starts) > 2:  # the end of a run that was too long to hold
                end = int(starts[1])
                if (out := rows(*[x[:end] for x in now], False)) is not None:
                    yield out
                now, open_run = [x[end:] for x in now], False
                starts = starts[1:] - end
            last = int(starts[-2])
            if last > 0 and (out := rows(*[x[:last] for x in now], True)) is not None:
                yield out
            held = [x[last:] for x in now]
            if len(held[0]) > SIGNED_MEMBERS:
                # One member is held back for those that follow.
                if (out := rows(*held, False)) is not None:
                    yield out
                held, open_run = [x[-1:] for x in held], True
        if held is not None and len(held[0]) and (out := rows(*held, not open_run)) is not None:
            yield out

    return run


def _needed_sets(words: int, bits):
    """(node, members) of the sets that pass the filter; a task sends each set once."""
    schema = ["node", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = np.frombuffer(bits.value, np.uint8)
        seen: set[int] = set()
        rows: list[tuple] = []
        held = 0
        for _, _, own, node in _sets(batches, words):
            if not len(own) or node in seen:
                continue
            seen.add(node)
            bit = node % FILTER_BITS
            if not filter_[bit >> 3] >> (bit & 7) & 1:
                continue
            rows.append((node, own.tobytes()))
            held += 8 * len(own)
            if held >= PART_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], schema)

    return run


def _filter_of(nodes: DataFrame) -> bytes:
    """Bit n % FILTER_BITS for each node; set in tasks and merged word by word, so its size is fixed."""
    bit = F.pmod(F.col("node"), F.lit(FILTER_BITS))
    words = nodes.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(node, {FILTER_BITS}) & 63 AS INT))")).alias("bits")
    )
    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = words.toPandas()  # at most FILTER_BITS / 64 rows
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return out.tobytes()


# ---- the trees -----------------------------------------------------------------------------------------------------


class Tree:
    """R-tree over count vectors, packed by splitting at the median of the widest coordinate down to LEAF points."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, excess: np.ndarray, rests: np.ndarray, percent: int):
        self.sizes, self.counts, self.excess, self.rests, self.percent = sizes, counts, excess, rests, percent
        # Maximum corner, most excess, least and largest size, most n-grams from the cell's on.
        self.boxes: list[tuple[np.ndarray, int, int, int, int]] = []
        self.children: list[tuple[int, int] | np.ndarray] = []
        self.root = self._pack(np.arange(len(sizes)))

    def _pack(self, points: np.ndarray) -> int:
        if len(points) <= LEAF:
            content: tuple[int, int] | np.ndarray = points
        else:
            spread = self.sizes[points].max() - self.sizes[points].min()
            own = self.counts[points]
            widths = own.max(0).astype(int) - own.min(0)
            axis = int(widths.argmax())
            key = self.sizes[points] if spread > 4 * widths[axis] else own[:, axis]
            order = points[np.argsort(key, kind="stable")]
            half = len(order) // 2
            content = (self._pack(order[:half]), self._pack(order[half:]))
        self.boxes.append((
            self.counts[points].max(0).astype(np.int32), int(self.excess[points].max()),
            int(self.sizes[points].min()), int(self.sizes[points].max()), int(self.rests[points].max()),
        ))
        self.children.append(content)
        return len(self.boxes) - 1

    def _may_meet(self, a: int, other: Tree, b: int) -> bool:
        corner, excess, least, most, rest = self.boxes[a]
        corner2, excess2, least2, most2, rest2 = other.boxes[b]
        if most * 100 < least2 * self.percent or most2 * 100 < least * self.percent:
            return False
        bound = min(int(np.minimum(corner, corner2).sum()) + min(excess, excess2), rest, rest2)
        return bound >= required(least, least2, self.percent)

    def meet(self, other: Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (point here, point there) whose bound allows similarity; with itself, each pair once."""
        same, stack = other is self, [(self.root, other.root)]
        while stack:
            a, b = stack.pop()
            if (a != b or not same) and not self._may_meet(a, other, b):
                continue
            left, right = self.children[a], other.children[b]
            if isinstance(left, tuple) and (not isinstance(right, tuple) or a >= b or not same):
                if same and a == b:
                    stack += [(left[0], left[0]), (left[0], left[1]), (left[1], left[1])]
                else:
                    stack += [(left[0], b), (left[1], b)]
            elif isinstance(right, tuple):
                stack += [(a, right[0]), (a, right[1])]
            else:
                yield self._survivors(left, other, right, same and a == b)

    def _survivors(self, left: np.ndarray, other: Tree, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        bound = np.minimum(self.counts[left][:, None, :], other.counts[right][None, :, :]).sum(2, dtype=np.int32)
        bound = bound + np.minimum(self.excess[left][:, None], other.excess[right][None, :])
        bound = np.minimum(bound, np.minimum(self.rests[left][:, None], other.rests[right][None, :]))
        need = required(self.sizes[left][:, None], other.sizes[right][None, :], self.percent)
        hit = bound >= need
        if same:
            hit &= np.triu(np.ones(hit.shape, bool), 1)
        a, b = np.nonzero(hit)
        return left[a], right[b]


def _chunks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of a sorted partition, as many as have come together, and where they start and end."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if held.num_rows:
            starts = _starts(held, keys)
            if len(starts) > 1:
                yield held.slice(0, int(starts[-1])), starts
                held = held.slice(int(starts[-1])).combine_chunks()
    if held is not None and held.num_rows:
        yield held, np.append(_starts(held, keys), held.num_rows)


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    marks = np.zeros(table.num_rows, bool)
    marks[0] = True
    for key in keys:
        column = table.column(key).to_numpy()
        marks[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(marks)


def _leaf_pairs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs inside groups of at most LEAF rows, whose tree is a single leaf."""
    first, second = [], []
    for size in np.unique(sizes).tolist():
        if size > 1:
            a, b = np.triu_indices(size, 1)
            base = starts[sizes == size][:, None]
            first.append((base + a).reshape(-1))
            second.append((base + b).reshape(-1))
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _fine_codes(members: pa.ChunkedArray) -> list[np.ndarray]:
    """For each set its n-grams by 65,536 groups, equal ones numbered, as sorted codes: common codes are a fine bound."""
    codes = []
    for one in members.to_pylist():
        value = np.frombuffer(one, np.uint16).astype(np.int64)
        start = np.append(True, value[1:] != value[:-1])
        run = np.maximum.accumulate(np.where(start, np.arange(len(value)), 0))
        codes.append((value << 32) | (np.arange(len(value)) - run))
    return codes


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal entries of two sorted arrays without repeats."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int(np.count_nonzero(b[at] == a))


#: What `_search` returns: for each point its first partner in the order of nodes (a group of copies then gives as many
#: pairs as it has points), the points that have any partner with their cells, or all pairs that pass the fine bound too.
FIRST, POINTS, ALL = "first", "points", "all"


def _search(percent: int, mode: str):
    """Candidate pairs (a, b) of each block or pair of blocks, by `mode`; FIRST adds (a, a) for all points in some pair.

    Points with equal labels are never paired.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in _chunks(batches, ["cell", "block", "block2"]):
            nodes, labels, own, sizes, excess, place = (
                table.column(c).to_numpy() for c in ("node", "label", "own", "n", "excess", "place")
            )
            # Two sets that have nothing rarer in common than the cell's n-gram share at most what comes from it on; that
            # is so in the first of their common cells, and being found there is enough.
            rests = sizes - place
            counts = np.frombuffer(b"".join(table.column("point").to_pylist()), np.uint8).reshape(-1, GROUPS)
            bounds = np.append(starts, table.num_rows) if starts[-1] != table.num_rows else starts
            lengths = np.diff(bounds)
            group = np.repeat(np.arange(len(lengths)), lengths)
            blocked = np.bincount(group, weights=own != own[bounds[:-1]][group]) > 0
            leaves = (lengths <= LEAF) & ~blocked
            a, b = _leaf_pairs(bounds[:-1][leaves], lengths[leaves])
            low, high = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
            near = (low * 100 >= high * percent) & (labels[a] != labels[b])
            a, b = a[near], b[near]
            hits = [np.zeros(0, bool)]
            for start in range(0, len(a), 4_096):
                x, y = a[start : start + 4_096], b[start : start + 4_096]
                bound = np.minimum(counts[x], counts[y]).sum(1, dtype=np.int64) + np.minimum(excess[x], excess[y])
                bound = np.minimum(bound, np.minimum(rests[x], rests[y]))
                hits.append(bound >= required(sizes[x], sizes[y], percent))
            hit = np.concatenate(hits)
            found = [(a[hit], b[hit])]
            for n in np.flatnonzero(~leaves & (lengths > 1)).tolist():
                rows = np.arange(bounds[n], bounds[n + 1])
                if (labels[rows] == labels[rows[0]]).all():
                    continue
                here, there = rows, rows
                if blocked[n]:
                    two = own[rows] != own[rows[0]]
                    here, there = rows[~two], rows[two]
                left = Tree(sizes[here], counts[here], excess[here], rests[here], percent)
                right = Tree(sizes[there], counts[there], excess[there], rests[there], percent) if blocked[n] else left
                found += [(here[x], there[y]) for x, y in left.meet(right)]
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
            other = labels[a] != labels[b]
            a, b = a[other], b[other]
            if not len(a):
                continue
            if mode == ALL:
                row, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
                fine = _fine_codes(table.column("fine").take(pa.array(row)))
                first, second = codes[: len(a)], codes[len(a) :]
                bound = np.array([_common(fine[x], fine[y]) for x, y in zip(first, second, strict=True)])
                near = bound >= required(sizes[a], sizes[b], percent)
                a, b = nodes[a[near]], nodes[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                continue
            if mode == POINTS:
                row = np.unique(np.concatenate([a, b]))
                cell = table.column("cell").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[row]), pa.array(nodes[row]), pa.array(place[row])], ["cell", "node", "place"]
                )
                continue
            of, a, b = group[a], np.minimum(nodes[a], nodes[b]), np.maximum(nodes[a], nodes[b])
            needed = np.unique(np.concatenate([a, b]))
            if mode == FIRST:
                order = np.lexsort((a, b, of))
                of, a, b = of[order], a[order], b[order]
                lead = np.append(True, (b[1:] != b[:-1]) | (of[1:] != of[:-1]))
                a, b = a[lead], b[lead]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([a, needed])), pa.array(np.concatenate([b, needed]))], ["a", "b"]
            )

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            similar = np.zeros(batch.num_rows, bool)
            left, right = batch.column("left_members"), batch.column("right_members")
            for n in range(batch.num_rows):
                a = np.frombuffer(left[n].as_py(), np.uint64)
                b = np.frombuffer(right[n].as_py(), np.uint64)
                common = _common(a, b)
                similar[n] = 100 * common >= percent * (len(a) + len(b) - common)
            keep = pa.array(similar)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are similar."""
    rows = (
        pairs.filter("a <> b").distinct()
        .join(sets.select(F.col("node").alias("a"), F.col("members").alias("left_members")).hint("merge"), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("members").alias("right_members")).hint("merge"), "b")
    )
    return rows.mapInArrow(tidy(_verify(percent)), "a long, b long")


def _round(
    members: DataFrame, points: DataFrame, labels: DataFrame | None, percent: int, mode: str = FIRST
) -> DataFrame:
    """What `_search` finds among differently labelled members of the same cell, within and between its blocks."""
    rows = members.join(points.hint("merge"), "node")
    rows = rows.withColumn("label", F.col("node")) if labels is None else rows.join(
        labels.select("node", F.col("component").alias("label")).hint("merge"), "node", "left"
    ).withColumn("label", F.coalesce("label", "node"))
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn(
        "own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    )
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("partner", partner).withColumn("block", F.least("own", "partner")).withColumn(
        "block2", F.greatest("own", "partner")
    )
    keys = ["cell", "block", "block2"]
    rows = rows.select(*keys, "own", "node", "label", "n", "point", "excess", "place", *["fine"] * (mode == ALL))
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "own", "node")
    schema = "cell long, node long, place int" if mode == POINTS else "a long, b long"
    return dealt.mapInArrow(tidy(_search(percent, mode)), schema).distinct()


def _last_round(
    scratch: Scratch, members: DataFrame, points: DataFrame, labels: DataFrame, sets: DataFrame, percent: int
) -> DataFrame:
    """All pairs of differently labelled members that can be similar.

    A group of documents just below the threshold has many pairs that pass the bound of the points. So only its members
    are noted first, and search again with the first 16 bits of all their n-grams, which leave hardly any but similar pairs.
    """
    near = scratch.write("near", _round(members, points, labels, percent, POINTS))
    cells = scratch.write("near_cells", near.groupBy("cell").agg(F.count(F.lit(1)).alias("members")))
    fine = sets.mapInArrow(_fine, "node long, fine binary")
    return _round(join_groups(near, cells, "cell", "members"), points.join(fine.hint("merge"), "node"), labels, percent, ALL)


def _fine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first 16 bits of the hashes of each set, in order."""
    for batch in batches:
        short = [(np.frombuffer(x, np.uint64) >> np.uint64(48)).astype(np.uint16).tobytes() for x in batch.column("members").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(short, pa.binary())], ["node", "fine"])


# ---- the operator --------------------------------------------------------------------------------------------------


def near_duplicates(
    documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set has its distinct runs of `words` lower-cased words (A-Z only; words are cut at ASCII white space),
    with fewer words the whole sequence. Two documents link when 100 * intersection >= `percent` * union. component_id is
    the smallest id reachable by links. Documents without words or text have size 0, link with nothing, and are their own
    component. Null ids take part and are larger than all others: component_id is null where no id is reachable. Rows
    that repeat an id are documents of their own. Sets and n-grams are told apart by 64-bit hashes.
    """
    return _named(documents, words, percent, id_column, text, False).select("doc_id", "n_shingles", "component_id")


def _mark(text: str) -> Column:
    """Digest of a text; a null text counts as the empty one."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _named(documents: DataFrame, words: int, percent: int, id_column: str, text: str, choose: bool) -> DataFrame:
    """The rows of `near_duplicates`; with `choose` also each text's `mark`, and `chosen`.

    `chosen` is (unnamed, doc_id, node, mark) of the document that stands for the component: the smallest id, nulls
    last, then the smallest number of the set and digest of the text. It is null for documents without words.
    """
    spark, scratch = documents.sparkSession, Scratch(documents.sparkSession)
    small_batches(documents.sparkSession)
    sent = documents.select(
        F.col(id_column).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"),
        (_mark(text) if choose else F.lit(None).cast("binary")).alias("mark"),
    )
    kind = sent.schema["doc_id"].dataType
    everything = scratch.write(
        "profiles", sent.mapInArrow(tidy(_profile(words, to_arrow_type(kind))), PROFILES.format(id=kind.simpleString()))
    )
    order = spark.sparkContext.broadcast(frequencies(everything))
    profiled = everything.filter("part IS NULL")
    profiles = profiled.select("doc_id", "n_shingles", "node", *["mark"] * choose)

    only_text = sent.select("text")
    postings = only_text.mapInArrow(tidy(_postings(words, percent, order)), "cell long, n int, node long, place int")
    dealt = postings.repartition("cell").sortWithinPartitions("cell", "n", "node")
    shared = dealt.mapInArrow(tidy(_shared_cells(percent)), "signature long, node long, place int")
    # Cells with the same members become one; the least place keeps its bound true for all of them.
    shared = scratch.write("shared", shared.groupBy(F.col("signature").alias("cell"), "node").agg(F.min("place").alias("place")))
    cells = scratch.write("cells", shared.groupBy("cell").agg(F.count(F.lit(1)).alias("members")))
    members = scratch.write("members", join_groups(shared, cells, "cell", "members"))
    scratch.drop("shared", "cells")

    point = F.first(F.struct(F.col("n_shingles").alias("n"), "point", "excess")).alias("p")
    points = profiled.filter("n_shingles > 0").groupBy("node").agg(point).select("node", "p.*")
    stars = scratch.write("stars", _round(members, points, None, percent))
    # Only sets with a candidate partner are needed from here on.
    needed = scratch.write("needed", stars.filter("a = b").select(F.col("a").alias("node")))
    members = scratch.write("close", members.join(needed.hint("merge"), "node", "left_semi"))
    points = scratch.write("points", points.join(needed.hint("merge"), "node", "left_semi"))
    bits = spark.sparkContext.broadcast(_filter_of(needed))
    found = only_text.mapInArrow(tidy(_needed_sets(words, bits)), "node long, members binary")
    # Several tasks may have met the same set.
    sets = scratch.write("sets", found.join(needed.hint("merge"), "node", "left_semi").groupBy("node").agg(
        F.first("members").alias("members")
    ))

    links = scratch.write("links1", _linked(stars, sets, percent))
    labels = scratch.write("labels1", components(links, "a", "b"))
    stars = scratch.write("stars2", _round(members, points, labels, percent))
    links = links.unionByName(scratch.write("links2", _linked(stars, sets, percent)))
    labels = scratch.write("labels2", components(links, "a", "b"))
    rest = scratch.write("rest", _last_round(scratch, members, points, labels, sets, percent))
    links = links.unionByName(scratch.write("links3", _linked(rest, sets, percent)))
    labels = scratch.write("labels", components(links, "a", "b"))
    scratch.drop("sets", "points", "close", "members", "stars", "stars2", "near", "near_cells", "rest")

    least = [F.min("doc_id").alias("least")]
    if choose:
        least.append(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node", "mark")).alias("best"))
    with_set = profiles.filter("n_shingles > 0")
    of_node = with_set.groupBy("node").agg(*least, F.count(F.lit(1)).alias("n_documents"))
    of_node = of_node.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    of_node = scratch.write("nodes", of_node)
    named = [F.min("least").alias("component_id"), *[F.min("best").alias("chosen")] * choose]
    of_component = scratch.write("components", of_node.groupBy("component").agg(
        *named, F.count(F.lit(1)).alias("n_nodes")
    ))
    chosen = ["chosen"] * choose
    of_node = scratch.write("named", join_groups(
        of_node.select("node", "component", "n_documents"), of_component, "component", "n_nodes"
    ).select("node", "component_id", "n_documents", *chosen))
    found = join_groups(with_set, of_node, "node", "n_documents")
    without = profiles.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    if choose:
        without = without.withColumn("chosen", F.lit(None).cast(of_node.schema["chosen"].dataType))
    columns = ["doc_id", "n_shingles", "component_id", *["mark"] * choose, *chosen]
    return found.select(*columns).unionByName(without.select(*columns))


def keep_one(
    documents: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents with their own columns, one of each component: that with the smallest id, null ids last.

    Among rows that repeat that id the text decides, by hashes; of rows that repeat both, the first by the hash of all
    their columns stays. Documents without words or text all stay.
    """
    scratch = Scratch(documents.sparkSession)
    found = _named(documents, words, percent, id_column, text, True).filter("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("chosen.doc_id")) & (F.col("mark") == F.col("chosen.mark"))
    key = F.struct(F.col("doc_id").alias("id"), "mark").alias("key")  # fields of structs are equal where both are null
    keys = found.select(key, stays.alias("stays")).groupBy("key").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n"))
    # All that doesn't simply stay: dropped ones, and chosen ones that several rows repeat.
    keys = scratch.write("keys", keys.filter(~F.col("stays") | (F.col("n") > 1)))
    total = keys.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = keys.filter(F.col("n") > total // HOT_SHARE).select("key")
    rows = packed(documents, F.struct(F.col(id_column).alias("id"), _mark(text).alias("mark")).alias("key"))
    single = rows.join(F.broadcast(hot), "key", "left_anti").join(
        keys.filter(F.col("n") <= total // HOT_SHARE).select("key").hint("merge"), "key", "left_anti"
    ).select("row.*")
    repeated = scratch.write("repeated", keys.filter("stays").select("key", "n"))
    if repeated.isEmpty():
        return single
    first = join_groups(rows, repeated, "key", "n").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return single.unionByName(first.select("row.*"))
