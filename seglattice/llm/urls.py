"""URL filters: listed rules first, gradient-boosted trees on lexical features for all other URLs.

Rules name a host and the start of a path; a rule fits its host and all subdomains, and the longest rule wins. Host,
path and rule are built-in columns. The trees see lengths, depth, digit shares, entropy, hyphens, parameter counts and
statistics of host suffixes, and are fitted here, on labelled URLs, by histogram boosting of logistic loss. Where a
table brings no labels, the URLs that a rule decides are the labelled ones, and the trees carry what these have in
common over to all others.

Suffix statistics count all labelled URLs: by suffixes of one, two and three labels, hashed to PLACES each, so that
they have a bound whatever the input (suffixes that share a place share their counts). Hosts fall into FOLDS, and rows
of the fit see the statistics of the other folds, so that the trees learn what suffixes tell of hosts they have not
seen, and no row's label is in its own features. The fit takes at most
FIT_URLS labelled URLs of at most FIT_BYTES each, in the order of a hash, half of each class where there are as many.

Defined results: a null URL or one without "://" has an empty host and path, fits no rule and is judged by the trees
like any other; repeated URLs get equal verdicts; without labels of both classes the verdict is allow; an empty table
gives an empty result; further columns do not matter.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted

BLOCK, ALLOW = "block", "allow"
FIT_URLS, FIT_BYTES = 20_000, 2000
ROUNDS, DEPTH, RATE, BINS = 40, 3, 0.3, 32
#: Places for the statistics of each kind of suffix; suffixes hash to them, so they do not grow.
PLACES = 1 << 14
#: Labels of the suffixes that have statistics, and folds of hosts.
SUFFIXES, FOLDS = (1, 2, 3), 4

#: verdict, host, start of path
Rule = tuple[str, str, str]

_FOLD = {i: i + 32 for i in range(65, 91)}


def parse(url: str | None) -> tuple[str, str, str]:
    """Host (A-Z in lower case), path and the rest of a URL."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, rest = rest[:end].translate(_FOLD), rest[end:]
    end = min((i for c in "?#" if (i := rest.find(c)) >= 0), default=len(rest))
    return host, rest[:end], rest[end:]


def host_column(url: Column) -> Column:
    """From behind the first "://" up to "/", "?", "#" or the end, A-Z in lower case."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_column(url: Column) -> Column:
    """From behind the host up to "?", "#" or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_column(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The longest rule that fits as struct<size, rule, verdict>, null if none does; rules: a listed set of some hundreds at most."""
    listed = [(h.translate(_FOLD), p, v) for v, h, p in rules]
    if not listed:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    table = F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("start"), F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for h, p, v in listed))
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["start"]) & (host != ""))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def place_column(host: Column, labels: int) -> Column:
    """Where the statistics of the host's suffix of so many labels are kept."""
    return F.crc32(F.concat(F.lit(f"{labels}:"), F.substring_index(host, ".", -labels)).cast("binary")) % PLACES


def fold_column(host: Column) -> Column:
    return F.crc32(host.cast("binary")) % FOLDS


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def _digits(text: str) -> float:
    return sum(map(str.isdigit, text)) / len(text) if text else 0.0


def lexical(url: str | None) -> list[float]:
    host, path, rest = parse(url)
    query = rest[1:].partition("#")[0] if rest.startswith("?") else ""
    labels = host.split(".")
    return [
        len(url or ""), len(host), len(path), len(query), path.count("/"), len(labels), max(map(len, labels)), _digits(host), _digits(path),
        _entropy(host), _entropy(path), host.count("-"), path.count("-") + path.count("_"), query.count("&") + 1 if query else 0, float("#" in rest), sum(not c.isalnum() for c in url or "") / max(1, len(url or "")),
    ]


def places(url: str | None) -> list[int]:
    """Where the statistics of a URL's suffixes are kept, in the order of SUFFIXES."""
    labels = parse(url)[0].split(".")
    return [zlib.crc32(f"{k}:{'.'.join(labels[-k:])}".encode("utf-8", "surrogatepass")) % PLACES for k in SUFFIXES]


def fold(url: str | None) -> int:
    return zlib.crc32(parse(url)[0].encode("utf-8", "surrogatepass")) % FOLDS


@dataclass
class Trees:
    """Boosted trees over quantile bins: tree t of depth DEPTH asks feature[t, node] > cut[t, node]."""

    base: float = -5.0
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1), np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, (1 << DEPTH) - 1)))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 1 << DEPTH)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((len(SUFFIXES), PLACES)))  # labelled URLs by kind of suffix and place
    blocked: np.ndarray = field(default_factory=lambda: np.zeros((len(SUFFIXES), PLACES)))
    prior: float = 0.0

    def table(self, urls: list[str | None], apart: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """Features; apart: for rows of the fit, the counts of each fold, of which their own is left out."""
        at, kinds = np.array([places(u) for u in urls], np.int64).reshape(-1, len(SUFFIXES)), np.arange(len(SUFFIXES))
        n, b = self.seen[kinds, at], self.blocked[kinds, at]
        if apart is not None:
            folds = np.array([fold(u) for u in urls])[:, None]
            n, b = n - apart[0][folds, kinds, at], b - apart[1][folds, kinds, at]
        return np.hstack([np.array([lexical(u) for u in urls], float).reshape(len(urls), -1), (b + 5 * self.prior) / (n + 5)])

    def margins(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - ((1 << DEPTH) - 1)]
        return out

    def scores(self, urls: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(self.table(urls)), -50, 50)))


def fit(labelled: Iterable[tuple[str | None, int]], counts: tuple[np.ndarray, np.ndarray] | None = None) -> Trees:
    """Trees from (url, 1 for block) rows in any order; counts: labelled and blocked URLs by fold and suffix, those of the rows if None."""
    rows = sorted({(u or "", int(bool(y))) for u, y in labelled})
    y = np.array([r[1] for r in rows], float)
    if not len(rows) or y.min() == y.max():
        return Trees()
    urls = [r[0] for r in rows]
    if counts is None:
        counts = np.zeros((FOLDS, len(SUFFIXES), PLACES)), np.zeros((FOLDS, len(SUFFIXES), PLACES))
        for u, label in rows:
            for i, p in enumerate(places(u)):
                counts[0][fold(u), i, p] += 1
                counts[1][fold(u), i, p] += label
    model = Trees(seen=counts[0].sum(axis=0), blocked=counts[1].sum(axis=0))
    model.prior = float(model.blocked[0].sum() / max(1.0, model.seen[0].sum()))
    x = model.table(urls, counts)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], axis=1)  # value > edges[k] if bin > k
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    model.base, margin = 0.0, np.zeros(len(y))
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        f, c = np.zeros((1 << DEPTH) - 1, np.int32), np.full((1 << DEPTH) - 1, np.inf)
        node = np.zeros(len(y), np.int64)
        for inner in range((1 << DEPTH) - 1):
            own = np.flatnonzero(node == inner)
            best = (1e-6, 0, np.inf)
            if len(own) > 1:
                total_g, total_h = g[own].sum(), h[own].sum()
                for k, e in enumerate(edges):
                    left_g = np.cumsum(np.bincount(bins[own, k], g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(bins[own, k], h[own], len(e) + 1))[:-1]
                    gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g**2 / (total_h + 1)
                    if len(gain) and gain.max() > best[0]:
                        best = (float(gain.max()), k, float(e[gain.argmax()]))
            f[inner], c[inner] = best[1], best[2]
            node[own] = 2 * inner + 1 + (x[own, best[1]] > best[2])
        at = node - ((1 << DEPTH) - 1)
        leaf = -RATE * np.bincount(at, g, 1 << DEPTH) / (np.bincount(at, h, 1 << DEPTH) + 1)
        margin += leaf[at]
        trees.append((f, c, leaf))
    model.feature, model.cut, model.leaf = (np.stack([t[i] for t in trees]) for i in range(3))
    return model


def rule_labels(pages: DataFrame, rules: Iterable[Rule], url_col: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule decides: 1 for block."""
    url = F.col(quoted(url_col))
    rule = rule_column(host_column(url), path_column(url), rules)
    return pages.select(url.alias("url"), rule.alias("rule")).where("rule IS NOT NULL").select("url", (F.col("rule.verdict") == BLOCK).cast("int").alias("label"))


def suffix_counts(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all (url, y) rows, how many there are and how many are blocked, by fold, kind of suffix and place."""
    seen, blocked = np.zeros((FOLDS, len(SUFFIXES), PLACES)), np.zeros((FOLDS, len(SUFFIXES), PLACES))
    host = host_column(F.col("url"))
    at = F.array(*(F.struct(F.lit(i).alias("kind"), place_column(host, k).alias("place")) for i, k in enumerate(SUFFIXES)))
    each = labelled.select("y", fold_column(host).alias("fold"), F.explode(at).alias("at")).groupBy("fold", "at.kind", "at.place").agg(F.count("*").alias("n"), F.sum("y").alias("b"))
    for r in each.collect():  # at most FOLDS * len(SUFFIXES) * PLACES rows
        seen[r["fold"], r["kind"], r["place"]], blocked[r["fold"], r["kind"], r["place"]] = r["n"], r["b"]
    return seen, blocked


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", fit_urls: int = FIT_URLS) -> Trees:
    """Statistics of all labelled URLs; trees fitted on at most fit_urls distinct ones."""
    own = labelled.select(F.col(quoted(url_col)).alias("url"), (F.col(quoted(label_col)) != 0).cast("int").alias("y")).where("url IS NOT NULL AND y IS NOT NULL")
    short = own.where(F.octet_length("url") <= FIT_BYTES).distinct()
    picked = [short.where(F.col("y") == y).orderBy(F.xxhash64("url"), "url").limit(fit_urls // 2) for y in (0, 1)]
    rows = [(r["url"], r["y"]) for r in picked[0].unionByName(picked[1]).collect()]
    return fit(rows, suffix_counts(own))


def score_udf(model):
    """model: a broadcast of Trees."""

    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in columns:
            yield pa.array(model.value.scores(batch.to_pylist()), pa.float64())

    return F.arrow_udf(score, "double")


def judge_urls(pages: DataFrame, rules: Iterable[Rule], *, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", model: Trees | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row; labelled: (url, label) rows, what the rules decide of the pages if None."""
    rules = list(rules)
    model = train(rule_labels(pages, rules, url_col) if labelled is None else labelled) if model is None else model
    url = F.col(quoted(url_col))
    own = pages.select(F.col(quoted(id_col)).alias("page_id"), host_column(F.coalesce(url, F.lit(""))).alias("host"), path_column(F.coalesce(url, F.lit(""))).alias("path"), url.alias("url"))
    scored = own.select("page_id", "host", "path", rule_column(F.col("host"), F.col("path"), rules).alias("r"), score_udf(pages.sparkSession.sparkContext.broadcast(model))(F.col("url")).alias("score"))
    method = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "score")
