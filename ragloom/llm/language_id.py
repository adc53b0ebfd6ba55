"""Language identification by a byte convolutional network, trained in numpy on labelled text.

Bytes are embedded, filters of several widths slide over a window of fixed length, the maximum of each filter goes to a
softmax. A text is cut into windows that cover all of it; the mean of their log probabilities decides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.functions.scale import small_batches
from ragloom.llm.common import buffers, fresh, pieces, tidy

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
UNKNOWN = "und"
#: Bounds of the training sample: languages (the most frequent), documents of each, windows of each document.
MAX_LANGUAGES = 256
DOCUMENTS = 300
#: Parts of a language in which the sample is cut first.
PARTS = 64
WINDOWS = 12
STEPS = 700
BATCH = 128
#: Windows that are convolved together, and bytes of text that are in work together.
BLOCK = 256
PIECE_BYTES = 1 << 20


@dataclass
class Model:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    weights: np.ndarray
    offset: np.ndarray


def _patches(embedded: np.ndarray, width: int) -> np.ndarray:
    """(windows, positions, width * DIM)"""
    parts = [embedded[:, j : embedded.shape[1] - width + 1 + j] for j in range(width)]
    return np.concatenate(parts, axis=2)


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def log_probabilities(model: Model, windows: np.ndarray) -> np.ndarray:
    """Log probability of each language for windows of WINDOW bytes (0 fills a short one)."""
    out = []
    for start in range(0, len(windows), BLOCK):
        embedded = model.embedding[windows[start : start + BLOCK]]
        pooled = [
            np.maximum((_patches(embedded, w).reshape(-1, w * DIM) @ k).reshape(len(embedded), -1, FILTERS).max(1) + b, 0)
            for w, k, b in zip(WIDTHS, model.filters, model.biases, strict=True)
        ]
        out.append(_log_softmax(np.concatenate(pooled, axis=1) @ model.weights + model.offset))
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)), np.float32)


def fit(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 1) -> Model:
    """Minimise the cross entropy of single windows with Adam; the same input and seed give the same model."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    embedding = rng.standard_normal((256, DIM)).astype(np.float32) * np.float32(0.5)
    filters = [small(w * DIM, FILTERS) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    weights, offset = small(FILTERS * len(WIDTHS), len(languages)), np.zeros(len(languages), np.float32)
    params = [embedding, *filters, *biases, weights, offset]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    by_label = [np.flatnonzero(labels == n) for n in range(len(languages))]
    for step in range(1, steps + 1):
        # Languages are drawn evenly, whatever their share of the sample.
        drawn = rng.integers(0, len(languages), BATCH)
        at = np.array([by_label[n][rng.integers(0, len(by_label[n]))] for n in drawn])
        batch = windows[at]
        embedded, pooled, where = embedding[batch], [], []
        for w, k, b in zip(WIDTHS, filters, biases, strict=True):
            response = (_patches(embedded, w).reshape(-1, w * DIM) @ k).reshape(BATCH, -1, FILTERS)
            where.append(response.argmax(1))
            pooled.append(np.maximum(response.max(1) + b, 0))
        hidden = np.concatenate(pooled, axis=1)
        error = np.exp(_log_softmax(hidden @ weights + offset))
        error[np.arange(BATCH), drawn] -= 1
        error /= BATCH
        grads_weights, grads_offset = hidden.T @ error, error.sum(0)
        back = (error @ weights.T) * (hidden > 0)
        grad_embedding, grads_filters, grads_biases = np.zeros_like(embedding), [], []
        row = np.arange(BATCH)[:, None]
        for n, (w, k) in enumerate(zip(WIDTHS, filters, strict=True)):
            g = back[:, n * FILTERS : (n + 1) * FILTERS]
            seen = np.stack([batch[row, where[n] + j] for j in range(w)], axis=2)
            patch = embedding[seen].reshape(BATCH, FILTERS, w * DIM)
            grads_filters.append(np.einsum("nf,nfd->df", g, patch))
            grads_biases.append(g.sum(0))
            to_patch = (g[:, :, None] * k.T[None]).reshape(BATCH, FILTERS, w, DIM)
            np.add.at(grad_embedding, seen.reshape(-1), to_patch.reshape(-1, DIM))
        grads = [grad_embedding, *grads_filters, *grads_biases, grads_weights, grads_offset]
        rate = 0.01 * (1 - step / (steps + 1))
        for p, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, embedding, filters, biases, weights, offset)


def cut(text: bytes) -> np.ndarray:
    """All windows of a text."""
    count = -(-len(text) // WINDOW)
    padded = np.zeros(count * WINDOW, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return padded.reshape(count, WINDOW)


def _sampled_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lang, place, number, bytes_ = [], [], [], []
        for one in batch.to_pylist():
            rows = cut(one["text"])
            rows = rows[: len(rows) - 1] if len(rows) > 1 else rows
            for n in np.unique(np.linspace(0, len(rows) - 1, min(WINDOWS, len(rows))).astype(int)) if len(rows) else ():
                lang.append(one["lang"])
                place.append(one["place"])
                number.append(int(n))
                bytes_.append(rows[n].tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(place, pa.int32()), pa.array(number, pa.int32()), pa.array(bytes_, pa.binary())],
            ["lang", "place", "number", "window"],
        )


def train(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    documents: int = DOCUMENTS,
    max_languages: int = MAX_LANGUAGES,
    steps: int = STEPS,
) -> Model | None:
    """Fit the network on a bounded sample: of each of the `max_languages` most frequent languages the `documents`
    documents with the smallest text hash, of each at most WINDOWS windows. Rows without text, letters or language are
    left out. None where nothing is left. The sample, at most max_languages * documents * WINDOWS windows of WINDOW bytes,
    reaches the driver.
    """
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(
        F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    )
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang")
    order = Window.partitionBy("lang").orderBy("place_hash", "bytes")
    parted = Window.partitionBy("lang", "part").orderBy("place_hash", "bytes")
    # The cut to `documents` per language is made on hashes, in parts of a language first, so that a frequent one is no
    # single task; then only those texts travel.
    hashed = rows.select("lang", F.xxhash64("text").alias("place_hash"), F.octet_length("text").alias("bytes")).distinct()
    chosen = (
        hashed.join(F.broadcast(frequent), "lang").withColumn("part", F.pmod("place_hash", F.lit(PARTS)))
        .withColumn("place", F.row_number().over(parted)).filter(F.col("place") <= documents)
        .withColumn("place", F.row_number().over(order)).filter(F.col("place") <= documents).drop("part")
    )
    # At most max_languages x documents rows.
    texts = rows.withColumn("place_hash", F.xxhash64("text")).withColumn("bytes", F.octet_length("text")).join(
        F.broadcast(chosen), ["lang", "place_hash", "bytes"]
    ).select("lang", "place", F.col("text").cast("binary").alias("text"))
    sample = texts.mapInArrow(tidy(_sampled_windows), "lang string, place int, number int, window binary").distinct().toPandas()
    if sample.empty:
        return None
    sample = sample.sort_values(["lang", "place", "number", "window"])
    languages = sorted(sample["lang"].unique())
    labels = sample["lang"].map({x: n for n, x in enumerate(languages)}).to_numpy()
    windows = np.frombuffer(b"".join(sample["window"]), np.uint8).reshape(-1, WINDOW)
    return fit(windows, labels, languages, steps)


def _window_index(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every window of the texts at `offsets`."""
    lengths = np.diff(offsets)
    counts = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[row] + number * WINDOW
    return start, np.minimum(start + WINDOW, offsets[row + 1]), row


def classify(model: Model, whole: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Most probable language (number) and its probability for each text; windows count by their bytes."""
    sums = np.zeros((len(offsets) - 1, len(model.languages)))
    start, end, row = _window_index(offsets)
    step = np.arange(WINDOW)
    for first in range(0, len(start), 8 * BLOCK):
        part = slice(first, first + 8 * BLOCK)
        at = start[part, None] + step
        inside = at < end[part, None]
        windows = np.where(inside, whole[np.where(inside, at, 0)], 0)
        values = log_probabilities(model, windows) * (end[part] - start[part])[:, None]
        np.add.at(sums, row[part], values)
    mean = sums / np.maximum(np.diff(offsets), 1)[:, None]
    probability = np.exp(_log_softmax(mean))
    best = probability.argmax(1)
    return best, probability[np.arange(len(best)), best]


def predict(documents: DataFrame, model: Model | None, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) with lang_pred and score for every whole text.

    Texts that are null or without a letter get UNKNOWN and score 0, as do all texts without a model. Columns of the
    input named lang_pred or score are replaced.
    """
    small_batches(documents.sparkSession)
    kept = [c for c in (documents.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    sent = documents.select(
        *[F.col(f"`{c}`") for c in kept],
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias(fresh("_bytes", kept)),
        F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(fresh("_letters", kept)),
    )
    schema = T.StructType(
        [*sent.schema.fields[: len(kept)], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*(model.languages if model else []), UNKNOWN], object)
        for whole in batches:
            for batch in pieces(whole, len(kept), PIECE_BYTES):
                known = batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
                number, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
                if model is not None and known.any():
                    texts, offsets = buffers(batch.column(len(kept)))
                    best, sure = classify(model, texts, offsets)
                    number, score = np.where(known, best, number), np.where(known, sure, 0.0)
                columns = [batch.column(n) for n in range(len(kept))]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(names[number], pa.string()), pa.array(score, pa.float64())],
                    [*kept, "lang_pred", "score"],
                )

    return sent.mapInArrow(tidy(run), schema)
