"""Toxicity by a support vector machine on a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings sums over their common subsequences of ORDER characters, each weighted by DECAY to the power
of the room it takes in both; so inserted characters and gaps lower a match but do not break it. Strings are the units
of a sentence: its words without outer punctuation, runs of single characters ("i d i o t") as one unit, two or three
neighbouring words joined where they begin and end like an insult ("id iot") and not both are ordinary words, and very
long words in overlapping pieces. A sentence, and so a document, is as toxic as its most toxic unit, and the more so if others come near it.

Fitting sees labelled sentences only by the label of their document. Units that toxic documents hold significantly more
often than clean ones (a likelihood ratio beyond what chance gives among so many units) are positive, and so are their
disguised forms: one character put in, doubled or left out. A toxic document without such a unit has one witness, its
most toxic unit, if the machine finds it so. All units of clean documents are negative; those of largest margin enter
the fit. Landmarks come from pivoted Cholesky steps over positive and negative units. A logistic curve turns the
largest margins of a document into its score; it is fitted on all of them and on those that a machine fitted on the
others has scored.
The fit uses at most FIT_DOCS labelled documents of at most FIT_BYTES each; scoring takes whole texts.

Defined results: null, empty and unit-less texts score as the margin of an empty string; without labelled rows of both
classes every score is the prior (0 without any); duplicated rows score alike; an id that labels repeat is toxic if one
of its rows is, and an id that documents repeat enters the fit with one of its texts; an empty table gives an empty
result. Not caught: insults made of several ordinary words.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import nlargest
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fresh, quoted, slices

ORDER, DECAY = 3, 0.6
#: Characters of a unit; longer words are taken in pieces that overlap by half.
UNIT_CHARS = 24
FIT_DOCS, FIT_BYTES = 3000, 20_000
LANDMARKS = 512
#: Clean units that the machine is trained on from the start, the most frequent, and those of largest margin in each round.
CLEAN_START, CLEAN_STEP = 3000, 1500
#: Positive units whose disguised forms are in the fit, and whose parts are looked for; the most frequent.
COMMON = 100
#: Share of the clean documents that have an ordinary word.
ORDINARY = 0.01
#: Letters that disguised forms have in each place, besides one.
PUT = 5
ROUNDS, RIDGE = 3, 1e-2
#: What a disguised form and a clean unit weigh in the fit; a clean unit also by the root of its documents.
VARIANT_COST, CLEAN_COST = 1.0, 1.0
#: What the most toxic unit of a toxic document counts alone in the curve.
SENTENCE = 0.1
#: The largest margin wanted, and the share of it from which a unit is an insult wherever it stands.
WANTED, DECISIVE = 5.0, 0.8
#: Units of a document that its score is made of, and the margins beyond which they do not count.
TOP, HELD = 3, (-0.5, 7.0)
#: A mark behind every unit, so that an insult's stem is not the insult.
END = "\n"
#: Units that a worker remembers in each of two generations.
MEMO_UNITS = 60_000
#: Numbers that are computed together.
CHUNK = 1_000_000
#: Codes of subsequences up to which a table of all of them is kept.
DENSE = 1 << 23


#: Marks around words; others are taken off one by one.
_MARKS = ".,;:!?\"'()#$%&*-|"


def unit_pieces(token: str) -> list[str]:
    """A token without outer punctuation, in pieces if it is long; with inner punctuation, its letters and digits alone too."""
    if not (token[:1].isalnum() and token[-1:].isalnum()):
        a, b = 0, len(token)
        while a < b and not token[a].isalnum():
            a += 1
        while b > a and not token[b - 1].isalnum():
            b -= 1
        token = token[a:b]
    bare = token if token.isalnum() else "".join(filter(str.isalnum, token))
    return _pieces(token) if bare == token else [*_pieces(token), *_pieces(bare)]


def _pieces(token: str) -> list[str]:
    if len(token) <= UNIT_CHARS:
        return [token] if token else []
    return [token[i : i + UNIT_CHARS] for i in range(0, len(token) - UNIT_CHARS // 2, UNIT_CHARS // 2)]


#: Three or more single letters or digits between spaces, single marks among them passed over.
_SPACED = re.compile(r"(?<= )(?:[^\W_] (?:[\W_] )*){3,}")
#: Beginnings and ends of insults, and which of them are ordinary words.
Parts = tuple[frozenset[str], frozenset[str], frozenset[str]]
NO_PARTS: Parts = (frozenset(), frozenset(), frozenset())


def joined(words: list[str], parts: Parts) -> set[str]:
    """Two or three neighbours in one, where the first begins and the last ends an insult, and one of them is no ordinary word."""
    begin, end, plain = parts
    out = set()
    for i, w in enumerate(words):
        if w in begin:
            for k in (i + 1, i + 2):
                if k < len(words) and (last := words[k].strip(_MARKS)) in end and not (w in plain and last in plain):
                    out.add("".join(words[i : k + 1]))
    return out


def tokens(text: str, parts: Parts = NO_PARTS) -> set[str]:
    """Distinct words in lower case, each run of three or more single characters as one token, and joined neighbours."""
    words = text.lower().split()
    out = set(words)
    if not parts[0].isdisjoint(out):
        out |= joined(words, parts)
    out.update("".join(filter(str.isalnum, run)) for run in _SPACED.findall(f" {' '.join(words)} "))
    return out


def units(text: str | None, parts: Parts = NO_PARTS) -> set[str]:
    return {p for t in tokens(text or "", parts) for p in unit_pieces(t)}


def parts_of(words: Iterable[str], ordinary: Callable[[str], bool] = lambda w: False) -> Parts:
    """Where a word that is split in two begins and ends."""
    cuts = [(w[:i], w[i:]) for w in words if len(w) > ORDER for i in range(1, len(w))]
    begin, end = frozenset(a for a, _ in cuts), frozenset(b for _, b in cuts)
    return begin, end, frozenset(filter(ordinary, begin | end))


def matrix(strings: list[str], pad: int) -> np.ndarray:
    """Code points, one string a row, padded."""
    out = np.full((len(strings), max(map(len, strings), default=0) or 1), pad, np.int32)
    for i, s in enumerate(strings):
        out[i, : len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def raw_kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Kernels of the strings in s (n rows) with those in t: (m, l) for all, or (n, 1, l) for each its own."""
    t = t if t.ndim == 3 else t[None]
    n, (_, m, size) = len(s), t.shape
    k = np.arange(size)
    decay = np.where(k[:, None] <= k, DECAY ** (k - k[:, None] + 2.0), 0).astype(np.float32)
    inner = [np.ones((n, m, size + 1), np.float32), *(np.zeros((n, m, size + 1), np.float32) for _ in range(ORDER - 1))]
    total = np.zeros((n, m), np.float32)
    for column in s.T:
        match = (column[:, None, None] == t).astype(np.float32)
        total += (match * inner[-1][:, :, :-1]).sum(axis=2)
        for i in range(ORDER - 1, 0, -1):
            inner[i][:, :, 1:] *= DECAY
            inner[i][:, :, 1:] += ((match * inner[i - 1][:, :, :-1]).reshape(-1, size) @ decay).reshape(n, m, size)
    return total * np.float32(DECAY**2)


def self_kernel(s: np.ndarray) -> np.ndarray:
    # the second copy's padding differs, so that padding never matches
    return raw_kernel(s, np.where(s < 0, -2, s)[:, None, :])[:, 0]


@cache
def subsequences(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of every subsequence of ORDER characters of n, a column for each character, and DECAY to its room."""
    at = np.array(list(combinations(range(n), ORDER)), np.int32).reshape(-1, ORDER)
    return at, (DECAY ** (at[:, -1] - at[:, 0] + 1.0)).astype(np.float32)


def coded(s: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A number below size ** ORDER for each subsequence of each row."""
    code = s[:, at[:, 0]].astype(np.int64)
    for i in range(1, ORDER):
        code = code * size + s[:, at[:, i]]
    return code


class Space:
    """The subsequences of some strings, numbered from 1; all others are 0."""

    def __init__(self, strings: list[str]):
        letters = sorted({c for t in strings for c in t + END})
        self.place = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)  # 0: no string has it
        self.place[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.size = len(letters) + 1
        own = [coded(self.place[None, [ord(c) for c in t + END]], subsequences(len(t) + 1)[0], self.size)[0] for t in strings]
        self.keys = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
        self.table = None
        if self.size**ORDER <= DENSE:
            self.table = np.zeros(self.size**ORDER, np.int32)
            self.table[self.keys] = np.arange(1, len(self.keys) + 1)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[codes]
        where = np.searchsorted(self.keys, codes)
        where[where == len(self.keys)] = 0
        return np.where(self.keys[where] == codes, where + 1, 0) if len(self.keys) else where

    def groups(self, strings: list[str], width: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For strings of one length at a time their places, subsequences, the rooms of these, and 1 / norm (0 without any)."""
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        for n in np.unique(lengths[lengths >= ORDER]).tolist():
            where, (at, room) = np.flatnonzero(lengths == n), subsequences(n + 1)
            chunk = max(1, CHUNK // (len(room) * width))
            for i in range(0, len(where), chunk):
                part = where[i : i + chunk]
                s = matrix([strings[k] + END for k in part.tolist()], -1)
                norm = np.sqrt(np.maximum(self_kernel(s), 1e-12))
                yield part, self.rows(coded(self.place[np.minimum(s, len(self.place) - 1)], at, self.size)), room, np.where(norm > 1e-5, 1 / norm, 0)

    def weights(self, strings: list[str]) -> np.ndarray:
        """A column for each string: the weight of each subsequence in its normalized kernels."""
        out = np.zeros((len(self.keys) + 1, len(strings)), np.float32)
        for part, rows, room, scale in self.groups(strings):
            np.add.at(out, (rows, np.broadcast_to(part[:, None], rows.shape)), room * scale[:, None])
        out[0] = 0
        return out

    def sums(self, strings: list[str], weights: np.ndarray) -> np.ndarray:
        """The weights of each string's subsequences, added up: its kernels with the strings that the columns are of."""
        out = np.zeros((len(strings), *weights.shape[1:]))
        for part, rows, room, scale in self.groups(strings, weights[0].size):
            out[part] = (room @ weights[rows] if weights.ndim > 1 else weights[rows] @ room) * (scale[:, None] if weights.ndim > 1 else scale)
        return out


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalized kernels; 0 for strings of fewer than ORDER characters."""
    space = Space(landmarks)
    return space.sums(strings, space.weights(landmarks))


@dataclass
class Model:
    """Margin of a unit: its kernels with the landmarks times weights, plus bias.

    Score of a document: logistic(slope . (largest margin, mean of the next TOP - 1) + shift).
    """

    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    slope: np.ndarray = field(default_factory=lambda: np.zeros(2))
    shift: float = -50.0
    parts: Parts = NO_PARTS

    def primal(self) -> tuple[Space, np.ndarray]:
        """The machine as one weight for each subsequence of the landmarks."""
        space = Space(self.landmarks)
        return space, (space.weights(self.landmarks) @ self.weights).astype(np.float32)

    def margins(self, strings: list[str], primal: tuple[Space, np.ndarray] | None = None) -> np.ndarray:
        """Equal to kernel(strings, landmarks) @ weights + bias, summed over subsequences instead of landmarks."""
        if not self.landmarks or not strings:
            return np.full(len(strings), float(self.bias))
        space, weights = self.primal() if primal is None else primal
        return space.sums(strings, weights) + self.bias

    def probability(self, tops: np.ndarray) -> np.ndarray:
        """tops: the largest margins of documents, as a Scorer gives them."""
        return 1 / (1 + np.exp(-np.clip(summary(tops) @ self.slope + self.shift, -60, 60)))


def summary(tops: np.ndarray) -> np.ndarray:
    """The largest margin, and the mean of the next ones."""
    held = np.clip(tops, *HELD)
    return np.column_stack([held[:, 0], held[:, 1:].mean(axis=1)]) if len(held) else np.zeros((0, 2))


def pivots(strings: list[str], n: int) -> list[str]:
    """Landmarks by pivoted Cholesky: each next string is the one that those before explain least."""
    strings = [s for s in strings if len(s) >= ORDER]
    if not strings or n <= 0:
        return []
    space, chosen = Space(strings), []
    known = list(space.groups(strings, len(strings)))
    steps, left = np.zeros((min(n, len(strings)), len(strings))), np.ones(len(strings))
    while len(chosen) < len(steps) and left.max() > 0.02:
        i = int(left.argmax())
        weight, gram = space.weights([strings[i]])[:, 0], np.zeros(len(strings))
        for part, rows, room, scale in known:
            gram[part] = (weight[rows] @ room) * scale
        k = len(chosen)
        steps[k] = (gram - steps[:k, i] @ steps[:k]) / math.sqrt(left[i])
        left = np.maximum(left - steps[k] ** 2, 0)
        left[i] = 0
        chosen.append(strings[i])
    return chosen


def disguised(word: str) -> set[str]:
    """The word with one character put in, doubled or left out."""
    out = set()
    for i in range(1, len(word)):
        code = zlib.crc32(f"{word}{i}".encode("utf-8", "surrogatepass"))
        put = {"x", *(chr(97 + code // 26**k % 26) for k in range(PUT))}
        out.update(word[:i] + c + word[i:] for c in put)
        out.add(word[:i] + word[i - 1 :])
    out.add(word + word[-1:])
    if len(word) > ORDER:
        out.update(word[:i] + word[i + 1 :] for i in range(len(word)))
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, target: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Primal squared-hinge SVM by Newton steps; y is +1 or -1, y * target the margin wanted; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float32, copy=False)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-6

    def slack(w):
        return np.maximum(0, target - y * (x @ w.astype(np.float32)))

    def loss(w, slack):
        return float((cost * slack**2).sum() + (penalty * w * w).sum())

    left = slack(w)
    now = loss(w, left)
    for _ in range(30):
        grad, hess = penalty * w, np.diag(penalty)
        inside = np.flatnonzero(left > 0)
        for at in range(0, len(inside), 2048):  # in blocks: no second copy of the rows
            own = inside[at : at + 2048]
            a, c = x[own], cost[own]
            grad -= (c * y[own] * left[own]) @ a
            hess += (a * c[:, None].astype(np.float32)).T @ a
        step = np.linalg.solve(hess, grad)
        size = 1.0
        while True:
            then = slack(w - size * step)
            new = loss(w - size * step, then)
            if new <= now or size < 1e-3:
                break
            size /= 2
        done = new > now * (1 - 1e-4)
        w, left, now = w - size * step, then, new
        if done:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Slopes, none negative, and shift by Newton steps with a little ridge, so that separable scores keep finite slopes."""
    x = x.reshape(len(y), -1)
    used = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([x[:, used], np.ones(len(y))])
        w, ridge = np.zeros(z.shape[1]), np.append(np.full(z.shape[1] - 1, 1e-2), 1e-9)
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
            grad = z.T @ (cost * (p - y)) + ridge * w
            hess = (z * (cost * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(hess, grad)
            w = w - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        slope = np.zeros(len(used))
        slope[used] = w[:-1]
        if (slope >= 0).all():
            return slope, float(w[-1])
        used &= slope >= 0


class Evidence:
    """How units spread over toxic and clean documents; prior: the share of toxic ones where the rows are not a fair sample."""

    def __init__(self, docs: list[tuple[list[str], int]], prior: float):
        self.n = Counter(y for _, y in docs)
        self.seen, self.prior = (Counter(), Counter()), prior
        for own, y in docs:
            self.seen[y].update(own)
        #: log likelihood ratios beyond this are rare among so many units
        self.rare = math.log(1 + sum(self.seen[0][u] + n > 2 for u, n in self.seen[1].items()))

    def toxic_share(self, u: str) -> float:
        """Of the documents with this unit, under the prior."""
        a, b = self.seen[1][u] / self.n[1] * self.prior, self.seen[0][u] / self.n[0] * (1 - self.prior)
        return a / (a + b) if a + b else 0.0

    def strong(self, u: str) -> bool:
        a, b, p = self.seen[1][u], self.seen[0][u], self.n[1] / (self.n[0] + self.n[1])
        if len(u) < ORDER or a <= (a + b) * p:
            return False
        ratio = a * math.log(a / ((a + b) * p)) + (b * math.log(b / ((a + b) * (1 - p))) if b else 0)
        return ratio > self.rare and self.toxic_share(u) >= 2 / 3

    def wanted(self, u: str) -> float:
        """The margin that a unit is to have: its log odds under the prior, within bounds."""
        a, b = (self.seen[1][u] + 0.01) / self.n[1] * self.prior, (self.seen[0][u] + 0.5) / self.n[0] * (1 - self.prior)
        return min(max(math.log(a / b), -1.0), WANTED)

    def odds(self, u: str) -> float:
        return math.log((self.seen[1][u] + 0.1) / (self.n[1] + 1)) - math.log((self.seen[0][u] + 0.1) / (self.n[0] + 1))


def machine(texts: list[tuple[str, int]], prior: float) -> Model:
    """Landmarks, weights and bias from (text, label) rows with both labels."""
    docs = [(sorted(units(t)), y) for t, y in texts]
    known = Evidence(docs, prior)
    wanted, seen = cache(known.wanted), known.seen
    strong = {u for u in seen[1] if known.strong(u)}
    toxic = [own for own, y in docs if y and any(len(u) >= ORDER for u in own)]
    open_ = [own for own in toxic if strong.isdisjoint(own)]  # no strong unit explains their label
    witness = Counter(u for own in open_ for u in nlargest(2, (u for u in own if len(u) >= ORDER), key=lambda u: (known.odds(u), u)))
    clean = {u for u in seen[0] if known.toxic_share(u) < 0.5}
    ranked = sorted(strong or witness, key=lambda u: (-seen[1][u], u))[:COMMON]
    parts = parts_of(ranked, lambda w: seen[0][w] >= ORDINARY * known.n[0])
    held = Counter({u: seen[0][u] for u in clean})  # clean documents with each clean unit, joined neighbours too
    held.update(p for t, y in texts if not y for j in joined(t.lower().split(), parts) for p in unit_pieces(j) if not seen[1][p])
    clean = set(held)
    every = sorted(clean)
    often = np.sqrt([held[u] + 1.0 for u in every])
    worst = sorted(clean, key=lambda u: (-held[u], u))[:CLEAN_START]
    hard = set(worst)
    family: set[str] = set()
    model, chosen, gram = Model(), [], {}
    for turn in range(ROUNDS):
        counts = Counter({u: seen[1][u] for u in strong | family}) + witness
        positive = sorted(counts, key=lambda u: (-counts[u], u))
        variants: dict[str, tuple[float, float]] = {}  # the margin wanted and the cost
        for u in positive[:COMMON]:
            if wanted(u) >= DECISIVE * WANTED or not strong:
                for v in disguised(u) - clean - counts.keys():
                    variants[v] = max(variants.get(v, (0.0, 0.0)), (wanted(u), VARIANT_COST * math.sqrt(counts[u])))
        forms = sorted(variants)
        if turn < ROUNDS - 1:  # fixed for the last round
            some = sorted(forms, key=lambda v: zlib.crc32(v.encode("utf-8", "surrogatepass")))[: 2 * LANDMARKS]
            chosen = pivots(positive[: 2 * LANDMARKS] + some, LANDMARKS // 2)
            sharp = [u for u in worst if len(u) >= ORDER]  # the clean units that weigh most are landmarks themselves
            for u in (*sharp[: LANDMARKS // 4], *pivots(sharp[: 3 * LANDMARKS], LANDMARKS // 4)):
                if u not in chosen:
                    chosen.append(u)
            space, gram = Space(chosen), {}
            weights = space.weights(chosen)
            own = space.sums(chosen, weights)
            value, vector = np.linalg.eigh((own + own.T) / 2)
            root = vector / np.sqrt(np.maximum(value, 1e-3))
        negative = sorted(hard)
        doubtful = [u for u in positive if wanted(u) < DECISIVE * WANTED]  # not beyond their odds
        new = [u for u in (*positive, *forms, *negative) if u not in gram]
        gram.update(zip(new, (space.sums(new, weights) @ root).astype(np.float32), strict=True))
        x = np.array([gram[u] for u in (*positive, *forms, *negative, *doubtful)])
        y = np.array([1.0] * (len(positive) + len(forms)) + [-1.0] * (len(negative) + len(doubtful)))
        cost = np.array(
            [math.sqrt(counts[u]) for u in positive] + [variants[v][1] for v in forms] + [CLEAN_COST * math.sqrt(held[u] + 1) for u in negative] + [CLEAN_COST * math.sqrt(seen[0][u] + 1) for u in doubtful]
        )
        target = np.array([max(wanted(u), 0.5) for u in positive] + [variants[v][0] for v in forms] + [-wanted(u) for u in negative] + [-max(wanted(u), 0.5) - 0.3 for u in doubtful])
        w = fit_svm(x, y, cost, target)
        model = Model(chosen, root @ w[:-1], float(w[-1]), parts=parts)
        margin = model.margins(every)
        worst = [every[i] for i in np.argsort(-(margin + 1) * often)[:CLEAN_STEP]]
        worst += [every[i] for i in np.argsort(-margin)[:CLEAN_STEP]]
        hard.update(worst)
        mine = sorted({u for own in toxic for u in own if len(u) >= ORDER} - clean)
        of = dict(zip(mine, model.margins(mine).tolist(), strict=True))
        family = {u for u in mine if of[u] > 0 and wanted(u) > 0.5}
        rest = [max((u for u in own if u in of), key=lambda u: (of[u] + 0.25 * min(known.odds(u), 4.0), u), default=None) for own in open_]
        witness = Counter(u for u in rest if u is not None and (of[u] > 0 or not strong))
    return model


def fit(labelled: Iterable[tuple[str | None, int]], prior: float | None = None) -> Model:
    """A model from (text, label) rows in any order; prior: the share of label 1 where the rows are not a fair sample."""
    rows = sorted((t or "", int(bool(y))) for t, y in labelled)
    n = Counter(y for _, y in rows)
    prior = n[1] / max(1, len(rows)) if prior is None else prior
    if not (n[0] and n[1]):
        return Model(shift=50.0 if prior >= 1 else math.log(prior / (1 - prior)) if prior > 0 else -50.0)
    model = machine(rows, prior)
    # the curve: on all rows, and on documents that another machine, fitted on the others, has scored, where there are enough
    fold = [zlib.crc32(t.encode("utf-8", "surrogatepass")) % 3 == 0 for t, _ in rows]
    apart, others = ([r for r, f in zip(rows, fold, strict=True) if f == side] for side in (True, False))
    enough = min(Counter(y for _, y in apart)[1], Counter(y for _, y in others)[1], Counter(y for _, y in apart)[0]) >= 20
    x, y, cost = _curve_rows(model, rows, prior)
    if enough:
        x, y, cost = (np.concatenate(c) for c in zip((x, y, cost), _curve_rows(machine(others, prior), apart, prior), strict=True))
    model.slope, model.shift = fit_logistic(x, y, cost)
    return model


def _curve_rows(model: Model, rows: list[tuple[str, int]], prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and costs of the curve; the costs add up to 1000."""
    top, y = summary(Scorer(model).margins([t for t, _ in rows])), np.array([label for _, label in rows], float)
    seen = (y == 0) | (top[:, 0] > 0)  # no curve explains toxic labels without any toxic unit
    if y[seen].any():
        top, y = top[seen], y[seen]
    toxic = y == 1
    # a toxic document counts in part as the sentence of its most toxic unit alone
    alone = np.column_stack([top[toxic][:, 0], np.full(int(toxic.sum()), HELD[0])])
    cost = np.where(toxic, (1 - SENTENCE) * prior / toxic.sum(), (1 - prior) / (~toxic).sum())
    return np.vstack([top, alone]), np.append(y, np.ones(len(alone))), np.append(cost, np.full(len(alone), SENTENCE * prior / toxic.sum())) * 1000


class Scorer:
    """The TOP largest margins of distinct units of texts; remembers tokens in two generations of bounded size."""

    def __init__(self, model: Model):
        self.model, self.memo, self.old = model, {}, {}
        self.primal = model.primal() if model.landmarks else None
        self.none = round(float(model.bias), 4)

    def margins(self, texts: Iterable[str | None]) -> np.ndarray:
        if len(self.memo) > MEMO_UNITS:
            self.old, self.memo = self.memo, {}
        found = [tokens(t or "", self.model.parts) for t in texts]
        memo, old, new = self.memo, self.old, []
        for t in set().union(*found):
            if t not in memo:
                if t in old:
                    memo[t] = old[t]
                else:
                    new.append(t)
        if new:
            bare = [t.strip(_MARKS) for t in new]  # most tokens are one short word
            plain = [p.isalnum() and len(p) <= UNIT_CHARS for p in bare]
            pieces = {t: unit_pieces(t) for t, one in zip(new, plain, strict=True) if not one}
            strings = sorted({p for p, one in zip(bare, plain, strict=True) if one and len(p) >= ORDER} | {p for own in pieces.values() for p in own if len(p) >= ORDER})
            # rounded, so that a unit has one margin in every batch
            margin = dict(zip(strings, self.model.margins(strings, self.primal).round(4).tolist(), strict=True))
            get, none = margin.get, self.none
            memo.update((t, get(p, none)) for t, p, one in zip(new, bare, plain, strict=True) if one)
            memo.update((t, max((get(p, none) for p in own), default=none)) for t, own in pieces.items())
        out = np.full((len(found), TOP), self.none)
        for row, own in zip(out, found, strict=True):
            margins = set(map(memo.__getitem__, own))  # equal margins are of one unit
            if len(margins) > TOP:
                row[:] = nlargest(TOP, margins)
            elif margins:
                row[:] = HELD[0]
                row[: len(margins)] = sorted(margins, reverse=True)
        return out


def score_udf(model):
    """model: a broadcast of a Model."""

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = model.value
        scorer = Scorer(own)
        for batch in texts:
            for piece in slices(batch):
                yield pa.array(own.probability(scorer.margins(x.as_py() for x in piece)))

    return F.arrow_udf(score, "double")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, id_col: str, text_col: str, fit_docs: int, fit_bytes: int) -> tuple[list[tuple[str | None, int]], float | None]:
    """At most fit_docs (text, label) rows, half of them of each class where there are as many, and the share of label 1.

    Rows are taken by a hash of their id, so any order of the table gives the same sample; longer texts are passed over.
    """
    own = labels.select(F.col(id_col).alias("id"), (F.col(label) != 0).cast("int").alias("y")).where("y IS NOT NULL AND id IS NOT NULL")
    own = own.where(keep(F.col("id"))).groupBy("id").agg(F.max("y").alias("y"))
    n = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not n:
        return [], None
    picked = None
    for y in sorted(n):
        # half of the rows, or what the other class leaves
        some = own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(max(fit_docs // 2, fit_docs - n.get(1 - y, 0)))
        picked = some if picked is None else picked.unionByName(some)
    # at most fit_docs ids, so a broadcast of fixed size; an id that documents repeat gives one text
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text") <= fit_bytes)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("text").alias("text")).collect()
    return [(r["text"], r["y"]) for r in rows], n.get(1, 0) / sum(n.values())


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> Model:
    """Fit on labelled rows whose crc32(id) mod 5 is not 0."""
    rows, prior = labelled_sample(docs, labels, "toxic", lambda i: crc_mod(i, 5) != 0, id_col, text_col, fit_docs, FIT_BYTES)
    return fit(rows, prior)


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    score = score_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(text_col))
    return docs.select(F.col(id_col).alias("doc_id"), score.alias("score")).select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """The rows whose score is below one half, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col) if model is None else model
    mark = fresh(docs, "score")
    scored = docs.withColumn(mark, score_udf(docs.sparkSession.sparkContext.broadcast(model))(F.col(quoted(text_col))))
    return scored.where(F.col(mark) < 0.5).select(*(F.col(quoted(c)) for c in docs.columns))
