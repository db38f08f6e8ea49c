"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line gets features of its bytes and words, those of the line before and after included, and one of two
labels, good or bad. Forward and backward messages give the marginal of each line; a document's share of good text is
the mean marginal weighted by line length, and a logistic curve turns it into a score.

Fitting sees labels of documents only. A logistic model of single lines, fitted with every line labelled as its
document, first tells the clean lines of bad documents; the field is then fitted to the lines so labelled, and the
curve to the shares of the documents. The fit uses at most FIT_DOCS labelled documents of at most FIT_BYTES each;
scoring takes whole texts.

Defined results: null, empty and blank texts have no lines and a share of zero; without labelled rows of both classes
every score is the prior (one half without any); duplicated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh, quoted, slices
from .toxicity import fit_logistic, labelled_sample

FIT_DOCS, FIT_BYTES = 3000, 50_000
#: Byte classes.
OTHER, LOWER, UPPER, DIGIT, SPACE, STOP, SHOUT, BAR, SYMBOL, HIGH = range(10)

_CLASS = np.full(256, OTHER, np.int64)
for _kind, _bytes in ((LOWER, bytes(range(97, 123))), (UPPER, bytes(range(65, 91))), (DIGIT, bytes(range(48, 58))), (SPACE, b" \t\r\n\x0b\x0c"), (STOP, b".,;:?'\"()-"), (SHOUT, b"!"), (BAR, b"|"), (SYMBOL, b"#$%&*@^~<>{}[]\\/_+=`"), (HIGH, bytes(range(128, 256)))):
    _CLASS[list(_bytes)] = _kind
_MIX = np.random.default_rng(7).integers(1, 1 << 40, 256, dtype=np.int64)
_CHUNK = 1 << 20


def lines_of(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """All bytes joined; where each non-blank line starts and ends; which text it is of; the number of texts."""
    data = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b"\n".join([*data, b""]), np.uint8)
    breaks = np.flatnonzero(joined == 10)
    starts = np.append(0, breaks[:-1] + 1) if len(breaks) else breaks
    first = np.cumsum([0, *(len(d) + 1 for d in data)])
    doc = np.searchsorted(first, starts, "right") - 1
    solid = np.append(0, np.cumsum(_CLASS[joined] != SPACE))
    keep = solid[breaks] > solid[starts]
    return joined, starts[keep], breaks[keep], doc[keep], len(data)


def features(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A row for each line: its own features, those of its neighbours in the text, and whether it has neighbours."""
    n = len(starts)
    if not n:
        return np.zeros((0, 3 * 17 + 3))
    counts = np.zeros((n, 10))
    for at in range(0, len(joined), _CHUNK):
        piece = joined[at : at + _CHUNK]
        place = np.arange(at, at + len(piece))
        line = np.searchsorted(starts, place, "right") - 1
        inside = (line >= 0) & (place < ends[np.maximum(line, 0)])
        counts += np.bincount(line[inside] * 10 + _CLASS[piece[inside]], minlength=10 * n).reshape(n, 10)
    length = (ends - starts).astype(float)
    solid = _CLASS[joined] != SPACE
    words = np.flatnonzero(solid & np.append(True, ~solid[:-1]))
    line = np.searchsorted(starts, words, "right") - 1
    sums = np.add.reduceat(np.where(solid, _MIX[joined], 0), words)
    n_words = np.bincount(line, minlength=n).astype(float)
    again = np.zeros(len(words), bool)
    again[1:] = (sums[1:] == sums[:-1]) & (line[1:] == line[:-1])
    pair = np.lexsort((sums, line))
    fresh_word = np.ones(len(words), bool)
    fresh_word[pair[1:]] = (sums[pair[1:]] != sums[pair[:-1]]) | (line[pair[1:]] != line[pair[:-1]])
    distinct = np.bincount(line[fresh_word], minlength=n) / n_words
    whole = np.bincount(line, weights=(sums % 1000003).astype(float), minlength=n).astype(np.int64) * 31 + (ends - starts)
    order = np.lexsort((np.arange(n), whole, doc))
    seen = np.zeros(n)
    seen[order[1:]] = (whole[order[1:]] == whole[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    letters = np.maximum(counts[:, LOWER] + counts[:, UPPER] + counts[:, HIGH] / 2, 1)
    share = lambda k: counts[:, k] / length
    upper, symbol, repeated = counts[:, UPPER] / letters, share(SYMBOL), np.bincount(line[again], minlength=n) / n_words
    own = np.column_stack([
        upper, share(DIGIT), 5 * symbol, 5 * share(SHOUT), 5 * share(BAR), 5 * share(STOP), share(HIGH), share(SPACE), np.log1p(length) / 5, np.minimum(length / n_words / 10, 3), repeated, distinct, seen,
        upper > 0.5, symbol > 0.08, repeated > 0.3, share(BAR) > 0.02,
    ])
    same = doc[1:] == doc[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:][same] = own[:-1][same]
    after[:-1][same] = own[1:][same]
    return np.column_stack([own, before, after, np.append(0, same), np.append(same, 0), np.ones(n)])


@dataclass
class Field:
    """weights: of a line's features for the label good. turn[a, b]: of label b after label a. slope and shift: of the score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * 17 + 3))
    turn: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 0.0
    shift: float = 0.0

    def messages(self, unary: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds of good over bad from the lines up to each (it included), and from those after it; texts in step."""
        n = len(unary)
        ahead, back = unary.astype(float).copy(), np.zeros(n)
        if not n:
            return ahead, back
        first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        size = np.diff(np.append(first, n))
        order = np.argsort(-size, kind="stable")
        first, size = first[order], size[order]
        live = len(first)
        steps = int(size[0])
        t = self.turn
        spans = []
        for k in range(1, steps):
            while size[live - 1] <= k:
                live -= 1
            spans.append(live)
            at = first[:live] + k
            m = ahead[at - 1]
            ahead[at] += np.logaddexp(t[0, 1], m + t[1, 1]) - np.logaddexp(t[0, 0], m + t[1, 0])
        last = first + size - 1
        for k in range(1, steps):
            at = last[: spans[k - 1]] - k
            m = unary[at + 1] + back[at + 1]
            back[at] = np.logaddexp(t[1, 0], t[1, 1] + m) - np.logaddexp(t[0, 0], t[0, 1] + m)
        return ahead, back

    def marginals(self, x: np.ndarray, doc: np.ndarray) -> np.ndarray:
        ahead, back = self.messages(x @ self.weights, doc)
        return 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))

    def shares(self, texts: Iterable[str | None]) -> np.ndarray:
        """The length-weighted share of good lines of each text."""
        joined, starts, ends, doc, n = lines_of(texts)
        good = self.marginals(features(joined, starts, ends, doc), doc)
        size = (ends - starts).astype(float)
        total = np.bincount(doc, weights=size, minlength=n)
        return np.bincount(doc, weights=size * good, minlength=n) / np.maximum(total, 1)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.shares(texts) + self.shift, -60, 60)))


def gradient(model: Field, x: np.ndarray, doc: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the mean log likelihood of the labels y: observed less expected features and label pairs."""
    unary = x @ model.weights
    ahead, back = model.messages(unary, doc)
    p = 1 / (1 + np.exp(-np.clip(ahead + back, -60, 60)))
    scale = cost.sum()
    w = x.T @ (cost * (y - p)) / scale
    left = np.flatnonzero(doc[1:] == doc[:-1])
    turn = np.zeros((2, 2))
    if len(left):
        right = left + 1
        score = np.stack([a * ahead[left] + model.turn[a, b] + b * (unary[right] + back[right]) for a in (0, 1) for b in (0, 1)])
        score = np.exp(score - score.max(axis=0))
        score /= score.sum(axis=0)
        for a in (0, 1):
            for b in (0, 1):
                turn[a, b] = (cost[left] * ((y[left] == a) & (y[right] == b)) - cost[left] * score[2 * a + b]).sum() / scale
    return w, turn


def ascend(model: Field, x: np.ndarray, doc: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int, ridge: float = 1e-3) -> Field:
    """Adam on all rows at once."""
    flat = np.concatenate([model.weights, model.turn.ravel()])
    mean, square = np.zeros_like(flat), np.zeros_like(flat)
    for k in range(1, steps + 1):
        model = Field(flat[:-4].copy(), flat[-4:].reshape(2, 2).copy())
        w, turn = gradient(model, x, doc, y, cost)
        g = np.concatenate([w, turn.ravel()]) - ridge * flat
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        flat = flat + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Field(flat[:-4].copy(), flat[-4:].reshape(2, 2).copy())


def fit(labelled: Iterable[tuple[str | None, int]], prior: float | None = None) -> Field:
    """A field from (text, label) rows in any order; prior: the share of label 1 where the rows are not a fair sample."""
    rows = sorted((t or "", int(bool(y))) for t, y in labelled)
    label = np.array([y for _, y in rows], float)
    if not len(rows):
        return Field()
    prior = label.mean() if prior is None else prior
    if label.min() == label.max():
        return Field(shift=60.0 if prior >= 1 else -60.0 if prior <= 0 else math.log(prior / (1 - prior)))
    texts = [t for t, _ in rows]
    joined, starts, ends, doc, n = lines_of(texts)
    x = features(joined, starts, ends, doc)
    per_doc = np.bincount(doc, minlength=n)
    cost = 1 / np.maximum(per_doc[doc], 1) ** 0.5
    # single lines: every line its own chain
    alone = ascend(Field(), x, np.arange(len(doc)), label[doc], cost, 150)
    good = alone.marginals(x, np.arange(len(doc)))
    y = label[doc].copy()
    worst = np.full(n, np.inf)
    np.minimum.at(worst, doc, good)
    y[(y == 0) & (good > 0.7) & (good > worst[doc])] = 1
    model = ascend(Field(alone.weights), x, doc, y, cost, 150)
    weight = np.where(label == 1, prior / label.sum(), (1 - prior) / (n - label.sum())) * n
    model.slope, model.shift = fit_logistic(model.shares(texts), label, weight)
    return model


def score_udf(model):
    """model: a broadcast of a Field."""

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for batch in texts:
            for piece in slices(batch):
                yield pa.array(own.scores(piece.to_pylist()))

    return F.arrow_udf(score, "double")


_LINE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("good", pa.float64())]))


def lines_udf(model):
    """A column of array<struct<start, end, good>>: each line's byte range in the UTF-8 text and the marginal of good."""

    def lines(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        for batch in texts:
            out = []
            for x in batch:
                joined, starts, ends, doc, _ = lines_of([x.as_py()])
                good = own.marginals(features(joined, starts, ends, doc), doc)
                out.append([{"start": a, "end": b, "good": g} for a, b, g in zip(starts.tolist(), ends.tolist(), good.tolist(), strict=True)])
            yield pa.array(out, _LINE)

    return F.arrow_udf(lines, "array<struct<start:bigint,end:bigint,good:double>>")


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Field:
    """Fit on labelled rows whose crc32(id) mod 3 is not 1."""
    rows, prior = labelled_sample(docs, labels, "quality", lambda i: crc_mod(i, 3) != 1, id_col, text_col, fit_docs, FIT_BYTES)
    return fit(rows, prior)


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    score = score_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Field | None = None) -> DataFrame:
    """The rows whose score is one half or more, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    mark = fresh(docs, "score")
    scored = docs.withColumn(mark, score_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(quoted(text_col))))
    return scored.where(F.col(mark) >= 0.5).select(*(F.col(quoted(c)) for c in docs.columns))
