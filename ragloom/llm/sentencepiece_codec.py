"""Sampled SentencePiece encoding and lossless decoding.

All ways to spell a text with the pieces of a vocabulary form a lattice. Forward filtering sums the weights of all paths
to each position, backward sampling draws one path from the end, each step with its exact conditional probability. The
random numbers hash the row's key and the position, so a row gets the same segmentation wherever it is encoded.

Pieces never reach over the start of a word's leading spaces, so the lattice of a text is a chain of the lattices of its
words. Each different word is filtered once a task and kept; paths of many words are drawn together. A very long word is
filtered in blocks: only the weights at the ends of blocks are kept, and a block is filtered again when its path is drawn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.scale import small_batches
from ragloom.llm.common import buffers, fresh, mix64, pieces, tidy

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stand-ins for single bytes inside a lattice.
BYTE = 0xF0000
UNIT = re.compile(" *[^ ]+| +")
UNIT_START = re.compile("(?<=[^ ]) ")
#: Characters of text and words in work at a time; words whose lattices a task keeps.
PART_CHARS = 1 << 19
FLUSH_UNITS = 50_000
KEPT_WORDS = 60_000
KEPT_EDGES = 1_500_000
#: A longer word is filtered on its own, in blocks of so many characters.
LONG_WORD = 1 << 14
LONG_BLOCK = 1 << 11


@dataclass
class Pieces:
    """A vocabulary: id and weight of each spelling, and the bytes that each id stands for."""

    ids: dict[str, int]
    weights: dict[str, float]
    spelled: list[bytes]
    longest: int
    key: int = field(default=0)


class Trie:
    """What tasks need of a vocabulary, as numpy arrays: transitions between the starts of pieces, and spelled bytes.

    It is built once and broadcast; a task's share of it is a few MB, that of the vocabulary's dictionaries tens of MB.
    """

    def __init__(self, vocabulary: Pieces):
        self.longest = vocabulary.longest
        self.chars = {p for p in vocabulary.ids if len(p) == 1}
        self.table = np.frombuffer(b"".join(vocabulary.spelled), np.uint8)
        self.sizes = np.array([len(x) for x in vocabulary.spelled], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        alphabet = {c: n + 1 for n, c in enumerate(sorted({c for p in vocabulary.ids for c in p}))}
        self.char_id = np.zeros(0x110000, np.int32)
        for c, n in alphabet.items():
            self.char_id[ord(c)] = n
        for byte in range(128):  # what ASCII has no piece for is one byte
            if byte != 32 and self.char_id[byte] == 0:
                self.char_id[byte] = alphabet.get(chr(BYTE + byte), 0)
        self.width = len(alphabet) + 1
        edges: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for piece, n in vocabulary.ids.items():
            state = 0
            for c in piece:
                state = edges.setdefault(state * self.width + alphabet[c], len(edges) + 1)
            ends[state] = (n, vocabulary.weights[piece])
        self.keys = np.array(sorted(edges), np.int64)
        self.child = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.ends, self.end_weight = np.full(len(edges) + 1, -1, np.int32), np.zeros(len(edges) + 1)
        for state, (n, weight) in ends.items():
            self.ends[state], self.end_weight[state] = n, weight


def load_pieces(model_file: str = DEFAULT_MODEL, exponent: float = 1.0) -> Pieces:
    """Read a model file. A piece weighs (10 + its rank by score) ** -exponent; larger exponents favour frequent pieces.

    Byte pieces only spell characters that no other piece spells, among them the visible space mark itself, so that
    decoding gives back every text.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    ids, weights, spelled, ranked = {}, {}, [], []
    for n in range(model.get_piece_size()):
        piece = model.id_to_piece(n)
        if model.is_byte(n):
            byte = int(piece[1:-1], 16)
            ids[chr(BYTE + byte)], weights[chr(BYTE + byte)] = n, 1.0
            spelled.append(bytes([byte]))
        elif model.is_control(n) or model.is_unknown(n) or model.is_unused(n):
            spelled.append(b"")
        else:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece reaches over a word start; its lattice is no chain of words")
            ids[piece] = n
            ranked.append((-model.get_score(n), n, piece))
            spelled.append(piece.replace(SPACE, " ").encode())
    for rank, (_, _, piece) in enumerate(sorted(ranked)):
        weights[piece] = (10.0 + rank) ** -exponent
    return Pieces(ids, weights, spelled, max(map(len, ids)), hash((model_file, exponent)))


class _Growing:
    """A numpy array that grows at its end; memory that was never written isn't there yet."""

    def __init__(self, kind, room: int):
        self.data, self.size = np.empty(room, kind), 0

    def extend(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.empty(max(need, 2 * self.size) - self.size, self.data.dtype)])
        self.data[self.size : need] = values
        self.size = need

    def view(self) -> np.ndarray:
        return self.data[: self.size]


class _Lattices:
    """Filtered lattices of words: for each node its incoming edges with cumulative probabilities."""

    def __init__(self, trie: Trie | Pieces):
        trie = Trie(trie) if isinstance(trie, Pieces) else trie
        self.longest, self.chars, self.width, self.char_id = trie.longest, trie.chars, trie.width, trie.char_id
        self.table, self.sizes, self.places = trie.table, trie.sizes, trie.places
        self.keys, self.child, self.ends, self.end_weight = trie.keys, trie.child, trie.ends, trie.end_weight
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.base, self.length = _Growing(np.int64, 2 * KEPT_WORDS), _Growing(np.int32, 2 * KEPT_WORDS)
        self.first = _Growing(np.int32, KEPT_EDGES)
        self.upto, self.piece, self.back = (
            _Growing(kind, KEPT_EDGES + KEPT_EDGES // 2) for kind in (np.float32, np.int32, np.int32)
        )
        self.nodes = 0

    def _spelled(self, word: str) -> str:
        """The word with the space mark for spaces and byte stand-ins for all that no piece spells."""
        out = []
        for c in word:
            if c == " ":
                out.append(SPACE)
            elif c in self.chars and c != SPACE and ord(c) < BYTE:
                out.append(c)
            else:
                out.extend(chr(BYTE + b) for b in c.encode("utf-8", "surrogatepass"))
        return "".join(out)

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words one after the other, and how many each word has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        strange = ((self.char_id[codes] == 0) & (codes != 32)) | (codes == ord(SPACE)) | (codes >= BYTE)
        if strange.any():
            for n in np.unique(np.repeat(np.arange(len(words)), length)[strange]).tolist():
                words[n] = self._spelled(words[n])
                length[n] = len(words[n])
            codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.where(codes == 32, np.uint32(ord(SPACE)), codes), length

    def add(self, words: list[str]) -> None:
        """Filter the lattices of new words; words of similar length are filtered together."""
        codes, length = self._codes(list(words))
        ids, first = self.char_id[codes].astype(np.int64), np.cumsum(length) - length
        # lengths up to 32 in steps of 4, then powers of two
        bucket = np.where(length <= 32, -(-length // 4) * 4, 1 << np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64))
        for size in np.unique(bucket).tolist():
            rows = np.flatnonzero(bucket == size)
            step = max(1, (1 << 20) // (size * self.longest))
            for low in range(0, len(rows), step):
                part = rows[low : low + step]
                self._filter(ids, first[part], length[part])
                for n in part.tolist():
                    self.words[words[n]] = len(self.words)

    def _filter(self, ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> None:
        """Sum path weights to node 1, 2, .. of all these words side by side."""
        count, width, longest = len(first), int(length.max()), self.longest
        word = np.repeat(np.arange(count), length)
        at = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
        left = np.repeat(length, length) - at
        symbol = first[word] + at
        base = np.cumsum(length + 1) - (length + 1)
        # weights of the pieces that end at a node, by their length
        weight, edges = np.zeros((width + 1, longest, count)), []
        state = np.zeros(len(word), np.int64)
        for step in range(longest):
            key = state * self.width + ids[symbol + step]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[found] == key
            word, at, left, symbol, state = word[hit], at[hit], left[hit], symbol[hit], self.child[found[hit]]
            whole = self.ends[state] >= 0
            of, start, end = word[whole], at[whole], state[whole]
            weight[start + step + 1, step, of] = self.end_weight[end]
            edges.append((of, start, np.full(len(of), step + 1), self.ends[end]))
            more = left > step + 1
            word, at, left, symbol, state = word[more], at[more], left[more], symbol[more], state[more]
            if not len(word):
                break
        alpha = np.zeros((width + 1, count))
        alpha[0] = 1.0
        for node in range(1, width + 1):
            reach = min(node, longest)
            weight[node, :reach] *= alpha[node - reach : node][::-1]
            alpha[node] = weight[node].sum(0)
            if node % longest == 0:  # only ratios matter, and only among nodes that a piece can bridge
                alpha[node - longest + 1 : node + 1] /= np.maximum(alpha[node - longest + 1 : node + 1].max(0), 1e-300)
        of, start, size, piece = (np.concatenate(x) for x in zip(*edges, strict=True))
        node = base[of] + start + size
        order = np.argsort(node * longest + size)
        of, start, size, piece, node = of[order], start[order], size[order], piece[order], node[order]
        total = int((length + 1).sum())
        first_edge = np.searchsorted(node, np.arange(total))
        share = weight[start + size, size - 1, of]
        heads = np.flatnonzero(np.diff(node, prepend=-1))
        sizes = np.diff(np.append(heads, len(node)))
        share /= np.repeat(np.maximum(np.add.reduceat(share, heads), 1e-300), sizes)
        running = np.cumsum(share)
        upto = running - np.repeat(running[heads] - share[heads], sizes)
        upto[heads + sizes - 1] = 1.0
        self.first.extend(self.upto.size + first_edge)
        self.upto.extend(upto)
        self.piece.extend(piece)
        self.back.extend(start)
        self.base.extend(self.nodes + base)
        self.length.extend(length)
        self.nodes += total

    def _edges(self, ids: np.ndarray, start: int, stop: int) -> list[list[tuple[int, float, int]]]:
        """For the nodes start + 1 .. stop of one word: (first node, weight, id) of the pieces that end there, short ones first."""
        longest = self.longest
        at = np.arange(max(start - longest + 1, 0), stop)
        symbol, state, found = at, np.zeros(len(at), np.int64), []
        for step in range(longest):
            key = state * self.width + ids[symbol]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[place] == key
            at, symbol, state = at[hit], symbol[hit] + 1, self.child[place[hit]]
            whole = (self.ends[state] >= 0) & (symbol > start)
            found.append((symbol[whole], at[whole], state[whole]))
            more = symbol < stop
            at, symbol, state = at[more], symbol[more], state[more]
        edges: list[list[tuple[int, float, int]]] = [[] for _ in range(stop - start)]
        for ends, firsts, states in found:
            for end, first, weight, piece in zip(
                ends.tolist(), firsts.tolist(), self.end_weight[states].tolist(), self.ends[states].tolist(), strict=True
            ):
                edges[end - start - 1].append((first, weight, piece))
        return edges

    def _weights(self, edges: list[list[tuple[int, float, int]]], start: int, known: list[float]) -> list[float]:
        """Path weights of the nodes from start - longest on; `known` has those up to `start`. Only ratios matter."""
        alpha, base = list(known), start + 1 - len(known)
        for n, own in enumerate(edges):
            alpha.append(sum(alpha[first - base] * weight for first, weight, _ in own))
            if n % 16 == 15 and not 1e-100 < alpha[-1] < 1e100:
                top = max(alpha[-self.longest - 16 :]) or 1.0
                alpha = [a / top for a in alpha]
        return alpha

    def sample_long(self, word: str, seed: int, start: int) -> np.ndarray:
        """Piece ids of one word of any length; memory beyond the word itself is that of one block."""
        codes, length = self._codes([word])
        ids, size, longest = self.char_id[codes].astype(np.int64), int(length[0]), self.longest
        blocks, kept = list(range(0, size, LONG_BLOCK)), [[1.0]]
        for low in blocks[:-1]:
            alpha = self._weights(self._edges(ids, low, low + LONG_BLOCK), low, kept[-1])[-longest:]
            top = max(alpha) or 1.0
            kept.append([a / top for a in alpha])
        found, node = [], size
        for low in reversed(blocks):
            known = kept.pop()
            edges = self._edges(ids, low, min(low + LONG_BLOCK, size))
            alpha, base = self._weights(edges, low, known), low + 1 - len(known)
            place = (start + np.arange(low, low + len(edges) + 1)).astype(np.uint64)
            draws = ((mix64(np.uint64(seed) ^ mix64(place * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(12)) * 2.0**-52).tolist()
            while node > low:
                own = edges[node - low - 1]
                shares = [alpha[first - base] * weight for first, weight, _ in own]
                left, chosen = draws[node - low] * sum(shares), 0
                while chosen < len(own) - 1 and left >= shares[chosen]:
                    left -= shares[chosen]
                    chosen += 1
                found.append(own[chosen][2])
                node = own[chosen][0]
        return np.array(found[::-1], np.int32)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of texts with these numbers of ids, one after the other, and where each ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        out = self.table[np.repeat(self.places[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, np.append(0, ends)[np.cumsum(counts)]

    def sample(self, words: np.ndarray, seeds: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all words in order, and how many each word has. `starts`: position of each word in its text."""
        base, at = self.base.view()[words], self.length.view()[words].astype(np.int64)
        first, upto, piece, back = self.first.view(), self.upto.view(), self.piece.view(), self.back.view()
        active = np.arange(len(words))
        counts, steps = np.zeros(len(words), np.int64), []
        while len(active):
            place = (starts[active] + at).astype(np.uint64)
            draw = (mix64(seeds[active] ^ mix64(place * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(12)) * 2.0**-52
            edge = first[base[active] + at].astype(np.int64)
            late = np.flatnonzero(upto[edge] <= draw)  # the last edge of a node has 1
            while len(late):
                edge[late] += 1
                late = late[upto[edge[late]] <= draw[late]]
            steps.append((active, piece[edge]))
            counts[active] += 1
            at = back[edge].astype(np.int64)
            left = at > 0
            active, at = active[left], at[left]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for n, (of, ids) in enumerate(steps):
            out[ends[of] - 1 - n] = ids
        return out, counts


def _parts(text: str) -> Iterator[str]:
    """A text in parts of about PART_CHARS that begin where a word begins."""
    start = 0
    while len(text) - start > PART_CHARS:
        cut = UNIT_START.search(text, start + PART_CHARS)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode_texts(lattices: _Lattices, texts: Sequence[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, and how many each text has."""
    found, sizes = [], np.zeros(len(texts), np.int64)
    waiting: list[tuple[int, int, list[str]]] = []  # text, position in it, words
    count = 0

    def flush() -> None:
        nonlocal waiting, count
        if len(lattices.words) > KEPT_WORDS or lattices.upto.size > KEPT_EDGES:
            lattices.clear()
        words = [w for _, _, part in waiting for w in part]
        if new := list(set(words).difference(lattices.words)):
            lattices.add(new)
        numbers = np.fromiter(map(lattices.words.__getitem__, words), np.int64, len(words))
        row = np.repeat([n for n, _, _ in waiting], [len(part) for _, _, part in waiting])
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        first = np.cumsum([0] + [len(part) for _, _, part in waiting])
        ends = np.cumsum(lengths)
        # A position in the text is a character times 4, so that nodes of single bytes have their own.
        start = ends - lengths
        start += np.repeat([at for _, at, _ in waiting] - start[first[:-1]], np.diff(first))
        ids, per_word = lattices.sample(numbers, seeds[row], start * 4)
        found.append(ids)
        np.add.at(sizes, row, per_word)
        waiting, count = [], 0

    for n, text in enumerate(texts):
        at = 0
        for part in _parts(" " + text) if text else ():
            units = UNIT.findall(part)
            if len(part) > LONG_WORD and max(map(len, units)) > LONG_WORD:
                for unit in units:
                    if len(unit) <= LONG_WORD:
                        waiting.append((n, at, [unit]))
                    else:
                        if waiting:
                            flush()
                        found.append(lattices.sample_long(unit, seeds[n], at * 4))
                        sizes[n] += len(found[-1])
                    at += len(unit)
                continue
            if waiting and count + len(units) > FLUSH_UNITS:
                flush()
            waiting.append((n, at, units))
            at, count = at + len(part), count + len(units)
    if waiting:
        flush()
    return (np.concatenate(found) if found else np.zeros(0, np.int32)), sizes


def _sent(documents: DataFrame, kept: list[str], text: str, key: str, seed: int) -> tuple[DataFrame, int]:
    """The columns `kept`, a seed, and the text if it isn't one of them: no text travels twice. Also the text's position."""
    small_batches(documents.sparkSession)
    columns = [F.col(f"`{c}`") for c in kept]
    seeds = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("null key")), F.lit(seed)).alias(fresh("_seed", kept))
    if text in kept and "." not in text and documents.schema[text].dataType == T.StringType():
        return documents.select(*columns, seeds), kept.index(text)
    return documents.select(*columns, seeds, F.coalesce(F.col(text), F.lit("")).alias(fresh("_text", kept))), len(kept) + 1


def _lattices_of(vocabulary: Trie | Pieces) -> _Lattices:
    return _Lattices(vocabulary)


def _encoded(lattices: _Lattices, batch: pa.RecordBatch, at: int, seeds: int):
    """Ids of the texts in column `at`, whose seeds are in `seeds`, how many each has, and the same as a list column."""
    ids, sizes = encode_texts(lattices, batch.column(at).to_pylist(), batch.column(seeds).to_numpy().view(np.uint64))
    offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return ids, sizes, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))


def encode(
    documents: DataFrame, vocabulary: Pieces, text: str = "text", key: str = "doc_id", seed: int = 0
) -> DataFrame:
    """All columns and `ids`, a sampled segmentation of the whole text; the same key, text and seed give the same ids.

    A space is put before the text, as the vocabulary expects. Null and empty texts have no ids. A null key is a key of
    its own; rows that repeat a key and text get equal ids. A column named ids is replaced.
    """
    kept = [c for c in documents.columns if c != "ids"]
    sent, at = _sent(documents, kept, text, key, seed)
    schema = T.StructType([*sent.schema.fields[: len(kept)], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    shared = documents.sparkSession.sparkContext.broadcast(Trie(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices_of(shared.value)
        for whole in batches:
            for batch in pieces(whole, at, PART_CHARS):
                *_, lists = _encoded(lattices, batch, at, len(kept))
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in range(len(kept))], lists], [*kept, "ids"])
        lattices.clear()

    return sent.mapInArrow(tidy(run), schema)


def round_trip(
    documents: DataFrame, vocabulary: Pieces, text: str = "text", key: str = "doc_id", seed: int = 0
) -> DataFrame:
    """What `encode` gives, decoded again in the same task: further columns n_bytes and decoded_sha256 of the decoded
    bytes, and lossless, which tells whether they are the text's own. Columns of these names are replaced.
    """
    added = ["ids", "n_bytes", "decoded_sha256", "lossless"]
    kept = [c for c in documents.columns if c not in added]
    sent, at = _sent(documents, kept, text, key, seed)
    schema = T.StructType([
        *sent.schema.fields[: len(kept)], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
        T.StructField("n_bytes", T.LongType()), T.StructField("decoded_sha256", T.StringType()),
        T.StructField("lossless", T.BooleanType()),
    ])
    shared = documents.sparkSession.sparkContext.broadcast(Trie(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices_of(shared.value)
        for whole in batches:
            for batch in pieces(whole, at, PART_CHARS):
                ids, sizes, lists = _encoded(lattices, batch, at, len(kept))
                decoded, ends = lattices.decode(ids, sizes)
                data, offsets = buffers(batch.column(at))
                counts, digests, same, start = [], [], [], 0
                for n, end in enumerate(ends.tolist()):
                    value = decoded[start:end].tobytes().removeprefix(b" ")
                    counts.append(len(value))
                    digests.append(hashlib.sha256(value).hexdigest())
                    same.append(value == data[offsets[n] : offsets[n + 1]].tobytes())
                    start = end
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(n) for n in range(len(kept))], lists, pa.array(counts, pa.int64()),
                        pa.array(digests, pa.string()), pa.array(same, pa.bool_()),
                    ],
                    [*kept, *added],
                )
        lattices.clear()

    return sent.mapInArrow(tidy(run), schema)


def decode_ids(vocabulary: Pieces, ids: Sequence[int]) -> bytes:
    spelled = vocabulary.spelled
    size = len(spelled)
    text = b"".join([spelled[n] for n in ids]) if not ids or 0 <= min(ids) <= max(ids) < size else b"".join(
        spelled[n] for n in ids if n is not None and 0 <= n < size
    )
    return text.removeprefix(b" ")


def decode(encoded: DataFrame, vocabulary: Pieces, ids: str = "ids") -> DataFrame:
    """All columns and `decoded`, the UTF-8 bytes that the ids spell, without the space before the text.

    Ids that the vocabulary doesn't have, and its control ids, spell nothing; null ids decode to null.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    sent = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([*sent.schema.fields, T.StructField("decoded", T.BinaryType())])
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                lists = part.column(kept.index(ids)).to_pylist()
                texts = [None if x is None else decode_ids(shared.value, x) for x in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*kept, "decoded"])

    return sent.mapInArrow(run, schema)
