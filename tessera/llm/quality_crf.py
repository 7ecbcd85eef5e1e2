"""Quality by a linear-chain conditional random field over lines.

The field labels every line of a document good or bad. A line's features are
measures of its characters and words and the same measures of the lines beside
it; a transition matrix ties neighbours. Forward-backward marginals, weighted
by the lines' lengths, give the document's share of good text, and a logistic
step turns that share into a score. Chains are whole documents, in fitting and
in scoring; products of their transitions are taken by doubling, so a chain of
n lines needs log n steps.

Labels are of documents: in fitting, the lines of a document carry its label,
and the field finds the lines that tell the two kinds apart. Texts are measured
where they are; the driver reads 64 bytes a line of a sample of at most
``labelled.MAX_ROWS`` labelled texts and ``MAX_LINES`` lines, whole texts in the
order of a hash.

Defined results: lines without characters are no lines; a null or empty text,
which has none, scores as a text half good. Each row is scored by itself,
repeated or not; equal lines of a text tie by place, the first being the
original. Very long texts are scored whole: lines are measured in runs, and a
line needs about 300 bytes. An empty table gives no row. Without labelled rows
of both kinds the field is even and the score is the share of good labels.
``classify`` reads no other columns; ``keep_good`` returns them as they are,
whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .labelled import held_out, sample_frame
from .stash import Stash

FOLDS, FOLD = 3, 1
RIDGE, STEPS = 1e-3, 200
#: Lines of the sample that is fitted on, with those of the text that reaches it.
MAX_LINES = 200_000
#: Bytes of lines that are measured at once.
RUN = 1 << 20

_LINE = np.ones(256, bool)
_LINE[10] = False


def _set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "symbol": _set(b"#$%&*<>[]{}\\^~=+@_"), "pipe": _set(b"|"), "bang": _set(b"!?"), "stop": _set(b".,;:"), "digit": _set(b"0123456789"),
    "capital": _set(bytes(range(65, 91))), "small": _set(bytes(range(97, 123))), "wide": _set(bytes(range(128, 256))),
}
MEASURES = (*_KINDS, "log_words", "word_chars", "long_words", "same_word", "few_words_kinds", "same_line", "short")


def _measure_run(data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The measures of lines by themselves; they start at ``starts`` of data and lie apart."""
    n, bounds = len(starts), np.stack([starts, starts + size], 1)
    count = lambda mask: (lambda c: c[bounds[:, 1]] - c[bounds[:, 0]])(np.concatenate([[0], np.cumsum(mask)]))
    columns = [count(mask[data]) / np.maximum(size, 1) for mask in _KINDS.values()]
    # Words of lines: every line is a row of its own here.
    words = tv.Words(data, np.concatenate([starts, [len(data)]]), fold=tv.FOLD)
    first = words.first
    k = np.diff(first)
    safe = np.maximum(k, 1)
    sums = lambda x: tv.row_sums(x.astype(np.int64), first)
    rows = words.rows()
    same = np.zeros(len(rows), bool)
    same[1:] = (words.hashes[1:] == words.hashes[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((words.hashes, rows))
    new = np.ones(len(rows), bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    kinds = np.bincount(rows[order][new], minlength=n)
    return columns + [np.log1p(k) / 5, sums(words.lens) / safe / 10, sums(words.lens > 20) / safe, sums(same) / safe, 1 - kinds / safe, k < 4]


def line_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(bytes by line, each row's range of lines, measures of the lines in runs) of a block of texts; the runs are made as they are taken."""
    lines = tv.Words(data, offsets, kind=_LINE)
    doc = lines.rows()
    order = np.lexsort((lines.hashes, doc))
    again = np.zeros(len(doc), bool)
    again[order[1:][(lines.hashes[order][1:] == lines.hashes[order][:-1]) & (doc[order][1:] == doc[order][:-1])]] = True

    def runs():
        lo = 0
        while lo < len(doc):
            hi = max(lo + 1, int(np.searchsorted(lines.ends, lines.starts[lo] + RUN, "right")))
            own = data[lines.starts[lo] : lines.ends[hi - 1]]
            columns = _measure_run(own, lines.starts[lo:hi] - lines.starts[lo], lines.lens[lo:hi])
            columns.insert(len(MEASURES) - 2, again[lo:hi])
            yield np.stack(columns, 1).astype(float)
            lo = hi

    return lines.lens.astype(float), lines.first, runs()


def line_measures(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures by line, bytes by line, each row's range of lines) of a block of texts."""
    size, first, runs = line_runs(data, offsets)
    return np.concatenate([np.zeros((0, len(MEASURES))), *runs]), size, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A line's measures, those of the lines before and after it in its document, and ones for what is there."""
    n, d = own.shape
    out = np.zeros((n, 3 * d + 3))
    out[:, :d] = own
    out[:, 3 * d] = 1
    inner = np.flatnonzero(_places(first) > 0)
    out[inner, d : 2 * d] = own[inner - 1]
    out[inner, 3 * d + 1] = 1
    out[inner - 1, 2 * d : 3 * d] = own[inner]
    out[inner - 1, 3 * d + 2] = 1
    return out


def _places(first: np.ndarray) -> np.ndarray:
    """Place of each line in its chain, from 0."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


class Chains:
    """Lines of documents as chains, with what products along them need."""

    def __init__(self, first: np.ndarray):
        self.ahead = _places(first).astype(np.int32)
        self.behind = (np.repeat(np.diff(first), np.diff(first)) - 1 - self.ahead).astype(np.int32)
        self.inner = np.flatnonzero(self.ahead > 0)
        self.starts = np.flatnonzero(self.ahead == 0)
        self.steps = [1 << k for k in range(int(self.ahead.max(initial=0)).bit_length())]

    @staticmethod
    def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Products of pairs of 2 x 2 matrices, each scaled to a largest entry of 1."""
        out = np.empty_like(a)
        for i in (0, 1):
            for j in (0, 1):
                out[:, i, j] = a[:, i, 0] * b[:, 0, j] + a[:, i, 1] * b[:, 1, j]
        out /= out.max((1, 2), keepdims=True)
        return out

    def marginals(self, odds: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of *good* by line, and expected turns summed over all chains.

        odds: log odds of good by line; turn: 2 x 2 log weights from one line's
        label to the next. After the step of d lines, each line has the product
        of the transitions of the 2 d lines up to it (or on from it).
        """
        if not len(odds):
            return np.zeros(0), np.zeros((2, 2))
        weight = np.exp(turn - turn.max())
        good = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        emit = np.stack([1 - good, good], 1)
        into = weight[None] * emit[:, None, :]  # from the line before to this one
        ahead = into.copy()
        # A chain's first line has no line before it: both rows are its own weights.
        ahead[self.starts] = emit[self.starts][:, None, :]
        for d in self.steps:
            at = np.flatnonzero(self.ahead >= d)
            ahead[at] = self._product(ahead[at - d], ahead[at])
        alpha = ahead[:, 0].copy()
        del ahead
        onward = np.empty_like(into)  # from this line to the next
        onward[:] = np.eye(2)
        onward[self.inner - 1] = into[self.inner]
        for d in self.steps:
            at = np.flatnonzero(self.behind >= d)
            onward[at] = self._product(onward[at], onward[at + d])
        beta = onward.sum(2)
        del onward
        both = alpha * beta
        inner = self.inner
        pair = alpha[inner - 1][:, :, None] * into[inner] * beta[inner][:, None, :]
        pair /= pair.sum((1, 2), keepdims=True)
        return both[:, 1] / both.sum(1), pair.sum(0)


def forward_backward(odds: np.ndarray, first: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``Chains.marginals`` of chains given by their ranges of lines."""
    return Chains(first).marginals(odds, turn)


class LineField:
    """Weights of a line's features, turns between labels, and the logistic step."""

    def __init__(self, weights: np.ndarray, turn: np.ndarray, slope: float, base: float):
        self.weights, self.turn, self.slope, self.base = weights, turn, slope, base

    def shares(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Share of good text by row."""
        size, first, runs = line_runs(data, offsets)
        d = len(MEASURES)
        # A line's part in its own odds, and in those of the lines after and before it.
        each = np.concatenate([np.zeros((0, 3)), *(own @ self.weights[: 3 * d].reshape(3, d).T for own in runs)])
        odds = each[:, 0] + self.weights[3 * d]
        inner = np.flatnonzero(_places(first) > 0)
        odds[inner] += each[inner - 1, 1] + self.weights[3 * d + 1]
        odds[inner - 1] += each[inner, 2] + self.weights[3 * d + 2]
        return self._share(odds, size, first)

    def _share(self, odds: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _ = forward_backward(odds, first, self.turn)
        total = tv.row_sums(size, first)
        return np.where(total > 0, tv.row_sums(size * good, first) / np.maximum(total, 1), 0.5)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * (self.shares(data, offsets) - 0.5), -40, 40)))

    @classmethod
    def fit(cls, rows: list[tuple[str, int]], steps: int = STEPS) -> LineField:
        """From texts and labels."""
        texts = pa.array([t for t, _ in rows], pa.large_string())
        return cls.fit_measures(measured_texts(texts), [label for _, label in rows], steps)

    @classmethod
    def fit_measures(cls, documents: list[np.ndarray], labels: list[int], steps: int = STEPS) -> LineField:
        """From the lines' measures and sizes of each document (see ``measured_texts``) and labels."""
        d = 3 * len(MEASURES) + 3
        y = np.array(labels, float)
        if not len(y) or y.min() == y.max():
            share = float(y.mean()) if len(y) else 0.5
            return cls(np.zeros(d), np.zeros((2, 2)), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
        length = np.array([len(x) for x in documents])
        first = np.concatenate([[0], np.cumsum(length)])
        lines = np.concatenate(documents).astype(float)
        x, size = with_neighbours(lines[:, :-1], first), lines[:, -1]
        gold = np.repeat(y, length)
        # Each kind of document counts alike.
        share = np.where(gold == 1, 0.5 / max(y.mean(), 1e-6), 0.5 / max(1 - y.mean(), 1e-6))
        w, turn = np.zeros(d), np.zeros((2, 2))
        m, v = np.zeros(d + 4), np.zeros(d + 4)
        n, chains = len(gold), Chains(first)
        if not n:
            return cls(w, turn, 0.0, 0.0)
        inner = chains.inner
        seen = np.diag([(gold[inner] == g).sum() for g in (0, 1)]).astype(float)
        for t in range(1, steps + 1):
            good, turns = chains.marginals(x @ w, turn)
            g = np.concatenate([x.T @ ((good - gold) * share) / n + RIDGE * w, ((turns - seen) / n + RIDGE * turn).ravel()])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = 0.1 / (1 + t / 60) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w -= move[:d]
            turn = turn - move[d:].reshape(2, 2)
        shares = cls(w, turn, 0.0, 0.0)._share(x @ w, size, first) - 0.5
        a, b = 4.0, 0.0
        for _ in range(50):  # Newton steps of the logistic step
            p = 1 / (1 + np.exp(-np.clip(b + a * shares, -40, 40)))
            r = p * (1 - p) + 1e-9
            grad = np.array([((p - y) * shares).sum() + 1e-2 * a, (p - y).sum()])
            hess = np.array([[(r * shares**2).sum() + 1e-2, (r * shares).sum()], [(r * shares).sum(), r.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a - np.clip(step[0], -5, 5), b - np.clip(step[1], -5, 5)
        return cls(w, turn, float(a), float(b))


def measured_texts(texts: pa.Array) -> list[np.ndarray]:
    """For each text one row a line: its measures and, last, its bytes."""
    out = []
    for _, data, offsets in tv.blocks(texts):
        own, size, first = line_measures(data, offsets)
        both = np.concatenate([own, size[:, None]], 1).astype(np.float32)
        out += [both[lo:hi] for lo, hi in zip(first[:-1], first[1:])]
    return out


def _measured(batches):
    for batch in batches:
        blobs = [x.tobytes() for x in measured_texts(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("h"), pa.array(blobs, pa.binary())], ["doc_id", "label", "h", "lines"])


def fit_field(docs: DataFrame, labels: DataFrame, label: str = "quality") -> LineField:
    """A field fitted on the labels that are not held out; see the module for its sample."""
    stash = Stash(docs.sparkSession, "quality")
    rows = sample_frame(docs, labels, label, FOLDS, FOLD).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label", F.xxhash64("text").alias("h"))
    width = len(MEASURES) + 1
    lines = stash.keep(rows.mapInArrow(_measured, "doc_id long, label int, h long, lines binary"), "lines")
    # Whole texts in order of a hash, up to the one that reaches the lines wanted.
    order = F.xxhash64("doc_id", "h")
    sizes = sorted(map(tuple, lines.select(order.alias("o"), (F.length("lines") / (4 * width)).cast("long").alias("k")).collect()))
    far = np.cumsum([k for _, k in sizes]) >= MAX_LINES
    last = sizes[int(np.argmax(far))][0] if far.any() else (1 << 63) - 1
    found = sorted(lines.where(order <= last).collect(), key=lambda r: (r["doc_id"], r["label"], r["h"]))
    stash.drop("lines")
    return LineField.fit_measures([np.frombuffer(r["lines"], np.float32).reshape(-1, width) for r in found], [r["label"] for r in found])


def _score(shipped):
    def run(batches):
        field = shipped.value
        for batch in batches:
            parts = [field.scores(data, offsets) for _, data, offsets in tv.blocks(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(parts) if parts else [], pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, field: LineField, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every row; reads the text alone."""
    shipped = docs.sparkSession.sparkContext.broadcast(field)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return plain.mapInArrow(_score(shipped), "doc_id long, score double")


def _keep_good(shipped):
    def run(batches):
        for batch in batches:
            for first, data, offsets in tv.blocks(batch.column("text")):
                good = shipped.value.scores(data, offsets) >= 0.5
                yield batch.slice(first, len(good)).filter(pa.array(good))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """Rows of ``docs`` (with a string column ``text``) that the field predicts good, all columns as they are."""
    field = fit_field(docs, labels, label)
    return docs.mapInArrow(_keep_good(docs.sparkSession.sparkContext.broadcast(field)), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted), the field fitted on labels that are not held out."""
    field = fit_field(docs, labels, label)
    return score(docs, field).select("doc_id", held_out(F.col("doc_id"), FOLDS, FOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
