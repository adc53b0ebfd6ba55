"""Personal data in texts: fixed patterns, and a character network that finds other ways to write the same things.

A bidirectional LSTM reads classes of characters, conditional random field transitions tie the tags of neighbours
together. Both are trained in numpy on labelled spans (`labelled_windows`). Texts are cut into overlapping windows that are
decoded in batches; the spans of all windows of a text are joined and the set of spans without overlap that has the
highest total score is taken. A span of the network counts only where it is valid (checksum, number of digits, parts).
"""

from __future__ import annotations

import functools
import hashlib
import ipaddress
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import buffers, fresh, pieces

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
HIDDEN = 12
#: Characters of a window, and those it shares with the next one; windows decoded together; bytes of text in work together.
WINDOW, OVERLAP = 256, 64
BLOCK = 512
PIECE_BYTES = 1 << 20
#: Training: windows made, their length, steps and windows a step.
EXAMPLES, LENGTH, STEPS, BATCH = 1_500, 80, 360, 40

# ---- fixed patterns --------------------------------------------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before the first one would have been matched with it: the look-behind only saves failing attempts.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    doubled = [(int(c) * 2 - 9 * (c > "4")) if n % 2 else int(c) for n, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each `@` once: the local part is the run before it, so long texts without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and without overlap per kind; matches that fail are dropped."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group()) if m.end() - m.start() <= 40 else ""
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def valid(kind: int, text: str) -> bool:
    """Whether a span of the network can be what it is taken for."""
    digits = _digits(text)
    if kind == 0:
        plain = re.sub(r"\s*[\[({]\s*(?:at|AT)\s*[\])}]\s*", "@", text)
        plain = re.sub(r"\s*[\[({]\s*(?:dot|DOT)\s*[\])}]\s*", ".", plain)
        return bool(re.fullmatch(r"\w(?:[\w.%+-]*[\w%+-])?@[\w-]+(?:\.[\w-]+)+", plain))
    if kind == 1:
        plain = re.sub(r"\s*[\[({]?\s*\.\s*[\])}]?\s*", ".", text)
        try:
            ipaddress.ip_address(plain)
        except ValueError:
            return False
        return len(digits) >= 4
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and bool(re.fullmatch(r"\d+(?:[^\w\s]\d+)+|\d+(?:\s\d+)+", text))
    if re.fullmatch(r"\d+(?:\.\d+){3,}|\d{3}(?:\D\d{3}){3,}", text):
        return False
    return 9 <= len(digits) <= 15 and len(re.findall(r"[0-9]+", text)) >= 3 and text.count("(") == text.count(")")


# ---- characters and labelled spans -----------------------------------------------------------------------------------


def _classes() -> np.ndarray:
    """Class of a character by the first byte of its UTF-8 form: letters, one for digits, each ASCII sign, groups of the rest."""
    table = np.zeros(256, np.uint8)
    for n in range(128):
        table[n] = 1 if n < 32 else n - 31
    table[ord("0") : ord("9") + 1] = table[ord("0")]
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    table[0xC2], table[0xC3:0xE0], table[0xE0:0xF0], table[0xE2], table[0xEF], table[0xF0:] = 100, 101, 102, 103, 104, 105
    return table


CLASSES = _classes()
WIDTH = 106


def _leads(raw: np.ndarray) -> np.ndarray:
    """The first byte of every character."""
    return raw[(raw & 0xC0) != 0x80]


class _Maker:
    """Labelled text made of words, spans of all kinds in many forms, and things that look like them."""

    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def pick(self, *options):
        return options[self.rng.integers(len(options))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        letters = "etaoinsrhldcumfpgwybvkjxqzéäößñçüè"
        size = 1 + min(int(self.rng.geometric(0.22)), 14)
        word = "".join(letters[n] for n in np.minimum(self.rng.exponential(9.0, size).astype(int), len(letters) - 1))
        return self.pick(word, word, word, word.capitalize(), word.upper())

    def name(self) -> str:
        parts = [re.sub(r"[^a-z]", "", self.word().lower()) or "a" for _ in range(self.rng.integers(1, 3))]
        return self.pick(".", "_", "-").join(parts) + self.pick("", "", self.digits(2))

    def host(self, dot: str = ".") -> str:
        return dot.join([self.name().split(".")[0], *self.pick(["com"], ["org"], ["de"], ["co", "uk"], ["example", "com"])])

    def email(self) -> str:
        a, b = self.pick(("(", ")"), ("[", "]"), ("{", "}"))
        gap = self.pick("", " ")
        return self.pick(
            lambda: f"{self.name()}@{self.host()}",
            lambda: f"{self.name()}{gap}{a}at{b}{gap}{self.host()}",
            lambda: f"{self.name()}{gap}{a}at{b}{gap}{self.host(f'{gap}{a}dot{b}{gap}')}",
            lambda: f"{self.word().lower()}ü{self.word().lower()}@{self.word().lower()}ö.{self.pick('de', 'com', 'fr')}",
        )()

    def ip(self) -> str:
        four = [self.digits(int(self.rng.integers(1, 4))) for _ in range(4)]
        six = [f"{self.rng.integers(1, 1 << 16) >> self.rng.integers(0, 12):x}" for _ in range(8)]
        return self.pick(
            ".".join(four), "[.]".join(four), "(.)".join(four), " . ".join(four), ":".join(six),
            f"{six[0]}{self.digits(2)}:{six[1]}::{six[2]}{self.digits(2)}",
        )

    def card(self) -> str:
        groups = self.pick([4, 4, 4, 4], [4, 6, 5], [4, 4, 4, 4, 3])
        return self.pick(*[s.join(self.digits(n) for n in groups) for s in (" ", "-", ".", "/", "_", " ", "·")])

    def filled(self, pattern: str) -> str:
        """The pattern with a digit for each 9."""
        return re.sub("9+", lambda m: self.digits(len(m.group())), pattern)

    def phone(self) -> str:
        return self.filled(self.pick(
            "+9 (999) 999-9999", "+99 999 9999999", "+99-999-999-9999", "(999) 999-9999", "999-999-9999", "999.999.9999",
            "0099 99 9999 999", "0999 999 9999", "9 (999) 999-9999", "+99/999/999999", "099/9999 999",
        ))

    def other(self) -> str:
        kind = int(self.rng.integers(0, 4))
        if kind:
            return self.filled(self.pick(
                "9999", "9" * int(self.rng.integers(1, 20)), "9.9", "9.99.9", "9999-99-99", "99.99.9999", "99:99:99",
                "9999-99-99 99:99", "9,999,999", "$ 999.99", "99 %", "999-9-99-999999-9", "v9.9.99", "#999999",
                "999 999 999 999", "9 99 999 9999 99", "9999/99", "(9999)", "99-99", "99999-9999", "[99]",
            ))
        return self.pick(
            lambda: f"@{self.name()}", lambda: f"{self.word()} @ {self.digits(2)}", lambda: f"{self.word()} @ {self.host()}",
            lambda: self.rng.bytes(20).hex(), lambda: f"https://{self.host()}/{self.digits(4)}", self.host,
            lambda: f"{self.word()} (at) {self.word()}",
        )()

    def text(self, length: int) -> tuple[str, np.ndarray]:
        parts, tags, size = [], [], 0
        while size < length + 40:
            kind = int(self.rng.integers(0, 9))
            if kind < len(KINDS):
                part = (self.email, self.ip, self.card, self.phone)[kind]()
                own = np.full(len(part), 2 * kind + 2, np.uint8)
                own[0] = 2 * kind + 1
            else:
                part = self.other() if kind < 6 else self.word()
                own = np.zeros(len(part), np.uint8)
            joint = " ".join(self.word() for _ in range(self.rng.integers(0, 4)))
            before = self.pick(" ", " ", " ", ". ", ", ", "\n", ": ", " (", ' "')
            joint = self.pick(" ", " ", ", ", ". ", "! ", ") ", "\n", "?? ") + joint + before
            parts += [part, joint]
            tags += [own, np.zeros(len(joint), np.uint8)]
            size += len(part) + len(joint)
        whole, labels = "".join(parts), np.concatenate(tags)
        cut = int(self.rng.integers(0, 40))
        while labels[cut] and labels[cut] % 2 == 0:  # never inside a span
            cut -= 1
        return whole[cut : cut + length], labels[cut : cut + length]


def labelled_windows(count: int, length: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Classes, tags (0 none, 2k + 1 first and 2k + 2 later characters of kind k) and texts, all of `length` characters."""
    maker = _Maker(seed)
    made = [maker.text(length) for _ in range(count)]
    classes = np.stack([CLASSES[_leads(np.frombuffer(text.encode(), np.uint8))] for text, _ in made])
    return classes, np.stack([tags for _, tags in made]), [text for text, _ in made]


# ---- the network -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """For both directions: input table, recurrent weights; then the output weights, their offset, transitions, start."""

    params: list[np.ndarray]

    @classmethod
    def new(cls, seed: int, hidden: int = HIDDEN) -> Model:
        rng = np.random.default_rng(seed)
        params = []
        for _ in range(2):
            table = (rng.standard_normal((WIDTH, 4 * hidden)) * 0.4).astype(np.float32)
            table[:, hidden : 2 * hidden] += 1.0  # gates that forget start open
            params += [table, (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)]
        params += [(rng.standard_normal((2 * hidden, TAGS)) * 0.3).astype(np.float32), np.zeros(TAGS, np.float32)]
        return cls([*params, np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)])


def _forbidden() -> tuple[np.ndarray, np.ndarray]:
    """A later character follows the first or a later one of its own kind only."""
    moves, start = np.zeros((TAGS, TAGS), np.float32), np.zeros(TAGS, np.float32)
    for kind in range(len(KINDS)):
        later = 2 * kind + 2
        moves[:, later], start[later] = -1e4, -1e4
        moves[[later - 1, later], later] = 0
    return moves, start


MOVES, START = _forbidden()


def _gates(z: np.ndarray, hidden: int) -> np.ndarray:
    """Sigmoid of input, forget and output gates and tanh of the candidate, in place."""
    z[:, : 3 * hidden] *= 0.5
    np.tanh(z, out=z)
    z[:, : 3 * hidden] *= 0.5
    z[:, : 3 * hidden] += 0.5
    return z


def _run(table: np.ndarray, weights: np.ndarray, classes: np.ndarray):
    """Hidden states, cells and gates of one direction for `classes` (steps, windows)."""
    steps, count = classes.shape
    hidden = len(weights)
    h, c = np.zeros((steps + 1, count, hidden), np.float32), np.zeros((steps + 1, count, hidden), np.float32)
    gates = np.empty((steps, count, 4 * hidden), np.float32)
    for t in range(steps):
        z = _gates(table[classes[t]] + h[t] @ weights, hidden)
        gates[t] = z
        i, f, o, g = (z[:, n * hidden : (n + 1) * hidden] for n in range(4))
        c[t + 1] = f * c[t] + i * g
        h[t + 1] = o * np.tanh(c[t + 1])
    return h, c, gates


def _back(weights, classes, h, c, gates, grad_h, grad_table, grad_weights) -> None:
    steps, hidden = len(classes), len(weights)
    dh, dc, flows = np.zeros_like(h[0]), np.zeros_like(c[0]), np.empty_like(gates)
    for t in range(steps - 1, -1, -1):
        i, f, o, g = (gates[t][:, n * hidden : (n + 1) * hidden] for n in range(4))
        dh = dh + grad_h[t]
        squashed = np.tanh(c[t + 1])
        dc = dc + dh * o * (1 - squashed**2)
        dz = np.concatenate([
            dc * g * i * (1 - i), dc * c[t] * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)
        ], axis=1)
        flows[t] = dz
        dh, dc = dz @ weights.T, dc * f
    flat = flows.reshape(-1, 4 * hidden)
    grad_weights += h[:-1].reshape(-1, hidden).T @ flat
    grad_table += (classes.reshape(-1, 1) == np.arange(WIDTH)).astype(np.float32).T @ flat


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradients(model: Model, classes: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean negative log likelihood of the tag sequences (windows, steps), and its gradient for every parameter."""
    table_f, weights_f, table_b, weights_b, out, offset, moves, start = model.params
    x, y = classes.T, tags.T.astype(np.int64)
    steps, count = x.shape
    hidden = len(weights_f)
    forward, backward = _run(table_f, weights_f, x), _run(table_b, weights_b, x[::-1])
    states = np.concatenate([forward[0][1:], backward[0][1:][::-1]], axis=2)
    emission = states @ out + offset
    moved, first = moves + MOVES, start + START
    alpha = np.empty((steps, count, TAGS), np.float32)
    beta = np.zeros((steps, count, TAGS), np.float32)
    alpha[0] = first + emission[0]
    for t in range(1, steps):
        alpha[t] = _lse(alpha[t - 1][:, :, None] + moved, 1) + emission[t]
    for t in range(steps - 2, -1, -1):
        beta[t] = _lse(moved[None] + (beta[t + 1] + emission[t + 1])[:, None, :], 2)
    total = _lse(alpha[-1], 1)
    rows = np.arange(count)
    score = first[y[0]] + emission[np.arange(steps)[:, None], rows, y].sum(0) + moved[y[:-1], y[1:]].sum(0)
    d_emission = np.exp(alpha + beta - total[None, :, None])
    d_start = d_emission[0].sum(0)
    d_moves = np.zeros_like(moves)
    for t in range(1, steps):
        d_moves += np.exp(
            alpha[t - 1][:, :, None] + moved + (emission[t] + beta[t])[:, None, :] - total[:, None, None]
        ).sum(0)
    d_emission[np.arange(steps)[:, None], rows, y] -= 1
    np.add.at(d_start, y[0], -1)
    np.add.at(d_moves, (y[:-1].reshape(-1), y[1:].reshape(-1)), -1)
    grads = [np.zeros_like(p) for p in model.params]
    d_states = d_emission @ out.T
    _back(weights_f, x, *forward, d_states[:, :, :hidden], grads[0], grads[1])
    _back(weights_b, x[::-1], *backward, d_states[::-1, :, hidden:], grads[2], grads[3])
    grads[4] = states.reshape(-1, 2 * hidden).T @ d_emission.reshape(-1, TAGS)
    grads[5], grads[6], grads[7] = d_emission.sum((0, 1)), d_moves, d_start
    return float((total - score).mean()), [(g / count).astype(np.float32) for g in grads]


def fit(classes: np.ndarray, tags: np.ndarray, steps: int = STEPS, seed: int = 3) -> Model:
    """Adam on single batches; the same windows and seed give the same model."""
    model, rng = Model.new(seed), np.random.default_rng(seed)
    first, second = [np.zeros_like(p) for p in model.params], [np.zeros_like(p) for p in model.params]
    for step in range(1, steps + 1):
        at = rng.integers(0, len(classes), BATCH)
        _, grads = loss_and_gradients(model, classes[at], tags[at])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.02 * (1 - step / (steps + 1)) ** 0.7
        for p, g, m, v in zip(model.params, grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (norm + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


@functools.lru_cache(maxsize=1)
def train() -> Model:
    """The network for EXAMPLES made windows, which no input changes."""
    classes, tags, _ = labelled_windows(EXAMPLES, LENGTH, 11)
    return fit(classes, tags)


def emissions(model: Model, classes: np.ndarray) -> np.ndarray:
    """(steps, windows, tags) for `classes` (windows, steps); 0 stands for no character."""
    table_f, weights_f, table_b, weights_b, out, offset, _, _ = model.params
    hidden, x = len(weights_f), np.ascontiguousarray(classes.T)
    found = np.empty((len(x), len(classes), TAGS), np.float32)
    found[:] = offset
    for table, weights, part, order in (
        (table_f, weights_f, out[:hidden], range(len(x))), (table_b, weights_b, out[hidden:], range(len(x) - 1, -1, -1))
    ):
        h, c = np.zeros((len(classes), hidden), np.float32), np.zeros((len(classes), hidden), np.float32)
        for t in order:
            z = table[x[t]]
            z += h @ weights
            _gates(z, hidden)
            i, f, o, g = (z[:, n * hidden : (n + 1) * hidden] for n in range(4))
            c *= f
            c += i * g
            h = o * np.tanh(c)
            found[t] += h @ part
    found[x == 0] = np.where(np.arange(TAGS) == 0, 0, -1e4)
    return found


def viterbi(model: Model, emission: np.ndarray) -> np.ndarray:
    """Best tags (windows, steps)."""
    moved, first = model.params[6] + MOVES, model.params[7] + START
    steps, count, _ = emission.shape
    came = np.zeros((steps, count, TAGS), np.uint8)
    best = first + emission[0]
    for t in range(1, steps):
        ways = best[:, :, None] + moved
        came[t] = ways.argmax(1)
        best = ways.max(1) + emission[t]
    tags = np.zeros((steps, count), np.uint8)
    tags[-1] = best.argmax(1)
    for t in range(steps - 1, 0, -1):
        tags[t - 1] = came[t][np.arange(count), tags[t]]
    return tags.T


# ---- whole texts -----------------------------------------------------------------------------------------------------


def window_starts(length: int) -> np.ndarray:
    """Windows that cover a text; any OVERLAP neighbouring characters lie in one of them."""
    return np.arange(0, max(length - OVERLAP, 1), WINDOW - OVERLAP) if length else np.zeros(0, np.int64)


def _decode(model: Model, leads: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
    """(window, start, kind, end, score) of the spans in windows of the characters `leads`."""
    for block in range(0, len(starts), BLOCK):
        part = slice(block, block + BLOCK)
        at = starts[part, None] + np.arange(WINDOW)
        inside = at < stops[part, None]
        classes = np.where(inside, CLASSES[leads[np.where(inside, at, 0)]], 0)
        emission = emissions(model, classes)
        gain = emission[:, :, 1:].max(2) - emission[:, :, 0]
        # Without a character that speaks for a tag the best path can't leave 0 but for its transitions.
        bonus = max(float((model.params[6] + MOVES).max()), 0.0) - min(float(model.params[6][0, 0]), 0.0)
        open_ = np.flatnonzero((gain + bonus).max(0) > 0)
        if not len(open_):
            continue
        tags = viterbi(model, emission[:, open_])
        row, place = np.nonzero((tags > 0) & (tags % 2 == 1))
        for r, p in zip(row.tolist(), place.tolist(), strict=True):
            kind, end = (int(tags[r, p]) - 1) // 2, p + 1
            while end < WINDOW and tags[r, end] == 2 * kind + 2:
                end += 1
            w = int(open_[r])
            own = emission[np.arange(p, end), w, tags[r, p:end]] - emission[p:end, w, 0]
            yield block + w, p, kind, end, float(own.sum())


def reconcile(spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) without overlap and with the highest total score, from (start, kind, end, score) of all windows.

    Overlapping spans of one kind, such as two views of a span that a window cuts, are joined first.
    """
    joined: list[list] = []
    for kind in range(len(KINDS)):
        for start, _, end, score in sorted(s for s in spans if s[1] == kind):
            if joined and joined[-1][1] == kind and start < joined[-1][2]:
                joined[-1][2], joined[-1][3] = max(joined[-1][2], end), max(joined[-1][3], score)
            else:
                joined.append([start, kind, end, score])
    joined.sort(key=lambda s: (s[2], s[0], s[1]))
    ends = np.array([s[2] for s in joined])
    best, before = [0.0], []
    for n, (start, _, _, score) in enumerate(joined):
        before.append(int(np.searchsorted(ends[:n], start, side="right")))
        best.append(max(best[-1], best[before[-1]] + max(score, 0.0)))
    chosen, n = [], len(joined)
    while n:
        if best[n] == best[n - 1]:
            n -= 1
        else:
            chosen.append(tuple(joined[n - 1][:3]))
            n = before[n - 1]
    return sorted(chosen)


def _added(model: Model, texts: list[tuple[str, np.ndarray]]) -> list[list[tuple[int, int, int]]]:
    """Valid spans of the network in each text (with its characters' first bytes)."""
    starts, stops, owner, base = [], [], [], 0
    for n, (_, leads) in enumerate(texts):
        own = window_starts(len(leads))
        if len(own):
            # A valid span has four digits, or an `@` or `at)`, so a window without them needs no network.
            digit = np.concatenate(([0], np.cumsum((leads >= 48) & (leads <= 57))))
            mark = leads == 64
            mark[2:] |= np.isin(leads[2:], (41, 93, 125)) & np.isin(leads[1:-1], (84, 116)) & np.isin(leads[:-2], (65, 97))
            marks = np.concatenate(([0], np.cumsum(mark)))
            end = np.minimum(own + WINDOW, len(leads))
            own = own[(digit[end] - digit[own] >= 4) | (marks[end] > marks[own])]
        starts.append(own + base)
        stops.append(np.full(len(own), base + len(leads)))
        owner.append(np.full(len(own), n))
        base += len(leads)
    found: list[list] = [[] for _ in texts]
    if not base:
        return found
    starts, stops, owner = np.concatenate(starts), np.concatenate(stops), np.concatenate(owner)
    first = np.cumsum([0, *[len(leads) for _, leads in texts]])
    leads = np.concatenate([leads for _, leads in texts])
    for window, start, kind, end, score in _decode(model, leads, starts, stops):
        n = int(owner[window])
        shift = int(starts[window] - first[n])
        found[n].append((start + shift, kind, end + shift, score))
    return [
        [s for s in reconcile(spans) if valid(s[1], text[s[0] : s[2]])] for spans, (text, _) in zip(found, texts, strict=True)
    ]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


FOUND = [*[f"n_{kind}" for kind in KINDS], "base_sha256", "spans", "n_added"]


def find(documents: DataFrame, text: str = "text", keep: Sequence[str] | None = None, model: Model | None = None) -> DataFrame:
    """The columns `keep` (all by default) with the personal data of every whole text.

    n_email, n_ip, n_card, n_phone count the spans of the fixed patterns, base_sha256 digests them as kind:start:end (code
    points, end exclusive, by start, then kind). `spans` lists those and the n_added ones of the network, which overlap
    none of the fixed ones.

    Null and empty texts have no spans. Rows that repeat are answered each. Columns of the input that are called like a
    result are replaced. A text of any length is read in windows, a task holds about PIECE_BYTES or one text at once.
    """
    kept = [c for c in (documents.columns if keep is None else keep) if c not in FOUND]
    name = fresh("_bytes", kept)
    sent = documents.select(
        *[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("binary"), F.lit(b"")).alias(name)
    )
    kinds = [T.LongType()] * len(KINDS) + [T.StringType(), T.StringType(), T.LongType()]
    schema = T.StructType([*sent.schema.fields[: len(kept)], *[T.StructField(c, k) for c, k in zip(FOUND, kinds, strict=True)]])
    network = model or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, len(kept), PIECE_BYTES):
                raw, offsets = buffers(batch.column(len(kept)))
                texts, fixed = [], []
                for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                    part = raw[a:b]
                    plain = part.tobytes().decode("utf-8", "replace")
                    if "�" in plain:
                        part = np.frombuffer(plain.encode(), np.uint8)
                    texts.append((plain, _leads(part)))
                    fixed.append(base_spans(plain))
                rows = []
                for base, more in zip(fixed, _added(network, texts), strict=True):
                    new = [s for s in more if all(s[2] <= b[0] or b[2] <= s[0] for b in base)]
                    counts = [sum(s[1] == n for s in base) for n in range(len(KINDS))]
                    digest = hashlib.sha256(_joined(base).encode()).hexdigest()
                    rows.append([*counts, digest, _joined(sorted(base + new)), len(new)])
                columns = [pa.array([r[n] for r in rows], pa.string() if n in (4, 5) else pa.int64()) for n in range(len(FOUND))]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in range(len(kept))], *columns], [*kept, *FOUND]
                )

    return sent.mapInArrow(run, schema)
