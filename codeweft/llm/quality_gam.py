"""A quality classifier that can be read: a generalised additive model with pairwise interactions.

Every feature is cut into bins, and a logistic model holds one lookup table a feature. Boosting goes round the features:
each in turn fits a shallow tree to the gradients summed by its bins and adds a small step of it to its own table. Then
the pairs of features whose joint bins explain most of what is left get tables of two dimensions in the same way. A text
is scored by adding up the entries of its bins.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import labelled, map_texts, one_text_each

#: At most about so many labelled rows are used to fit; they are picked by a hash, and all of them if there are fewer.
FIT_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 200, 60, 5, 0.15
LEAST_HESSIAN = 1.0
FEATURES = (
    "log_bytes", "log_words", "word_length", "symbols", "other_marks", "upper_case", "digits", "white_space", "not_ascii",
    "lines_a_word", "repeated_lines", "distinct_words", "top_word", "repeated_triples",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[[*chars]] = 1
    return out


CLASSES = np.stack([
    _mask(b"#*$%&|<>"),
    _mask(bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "#*$%&|<>")),
    _mask(bytes(range(65, 91))),
    _mask(bytes(range(48, 58))),
    _mask(bytes([9, 10, 11, 12, 13, 32])),
    _mask(bytes(range(128, 256))),
])


def features(text: str) -> list[float]:
    """The FEATURES of a whole text, all finite; an empty text has zeros and, for distinct_words, 1."""
    raw = text.encode("utf-8", "replace")
    shares = CLASSES @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(len(raw), 1)
    words = text.split()
    n = max(len(words), 1)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x.strip()]
    triples = max(len(words) - 2, 0)
    return [
        float(np.log1p(len(raw))), float(np.log1p(len(words))), sum(map(len, words)) / n, *shares.tolist(),
        len(lines) / n, 1 - len(set(lines)) / max(len(lines), 1), len(counts) / n if words else 1.0,
        max(counts.values(), default=0) / n, 1 - len(set(zip(words, words[1:], words[2:], strict=False))) / max(triples, 1) if triples else 0.0,
    ]


def bin_of(edges: np.ndarray, values: np.ndarray) -> np.ndarray:
    return np.searchsorted(edges, values, side="right")


def best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The cut of a row of bins into two that gains most, as (gain, first bin on the right); the gain is 0 if none does."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    ok = (left_h >= LEAST_HESSIAN) & (right_h >= LEAST_HESSIAN)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1), 0)
    return float(gain.max()), int(gain.argmax()) + 1


def line_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A shallow tree over the bins of one feature: the step for each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, i = max((*best_cut(g[a:b], h[a:b]), i) for i, (a, b) in enumerate(parts))
        if gain <= 1e-9:
            break
        a, b = parts[i]
        parts[i : i + 1] = [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in parts:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + 1)
    return step


def plane_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth two over the joint bins of two features: cuts one axis, then each side along the other."""
    best, step = -1.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        gain, at = best_cut(a.sum(1), b.sum(1))
        sides = ((0, at), (at, len(a))) if at else ((0, len(a)),)
        here = np.zeros_like(a)
        for i, j in sides:
            more, cut = best_cut(a[i:j].sum(0), b[i:j].sum(0))
            gain += more
            for k, m in ((0, cut), (cut, a.shape[1])) if cut else ((0, a.shape[1]),):
                here[i:j, k:m] = -a[i:j, k:m].sum() / (b[i:j, k:m].sum() + 1)
        if gain > best:
            best, step = gain, here.T if turned else here
    return step


@dataclass
class Gam:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for rows of features: additions of table entries and one logistic function."""
        z = np.full(len(x), self.base)
        for f, t in enumerate(self.tables):
            z += t[bin_of(self.edges[f], x[:, f])]
        for (a, b), t in self.pairs.items():
            z += t[bin_of(self.coarse[a], x[:, a]), bin_of(self.coarse[b], x[:, b])]
        return 1 / (1 + np.exp(-z))


def fit_gam(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fits the model to a bounded matrix of features and labels 0 or 1. Without both labels it predicts their share (0.5 without rows)."""
    if not len(y) or y.min() == y.max():
        return Gam(base=0.0 if not len(y) else (6.0 if y[0] else -6.0))
    m = Gam(base=float(np.log(y.mean() / (1 - y.mean()))))
    cuts = lambda k: [np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1], method="nearest")) for f in range(x.shape[1])]
    m.edges, m.coarse = cuts(BINS), cuts(PAIR_BINS)
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [bin_of(e, x[:, f]) for f, e in enumerate(m.edges)]
    z = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for f, b in enumerate(at):
            p = 1 / (1 + np.exp(-z))
            n = len(m.tables[f])
            step = RATE * line_tree(np.bincount(b, p - y, n), np.bincount(b, p * (1 - p), n))
            m.tables[f] += step
            z += step[b]
    p = 1 / (1 + np.exp(-z))
    at = [bin_of(e, x[:, f]) for f, e in enumerate(m.coarse)]
    joint, gains = {}, []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(m.coarse[a]) + 1, len(m.coarse[b]) + 1)
            joint[a, b] = (at[a] * shape[1] + at[b], shape)
            g, h = (np.bincount(joint[a, b][0], v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))
            gains.append((float((g**2 / (h + 1)).sum() - (g.sum(1) ** 2 / (h.sum(1) + 1)).sum() - (g.sum(0) ** 2 / (h.sum(0) + 1)).sum()), -a, -b))
    chosen = [(-a, -b) for _, a, b in sorted(gains, reverse=True)[:PAIRS]]
    m.pairs = {k: np.zeros(joint[k][1]) for k in chosen}
    for _ in range(PAIR_ROUNDS):
        for k in chosen:
            b, shape = joint[k]
            p = 1 / (1 + np.exp(-z))
            g, h = (np.bincount(b, v, shape[0] * shape[1]).reshape(shape) for v in (p - y, p * (1 - p)))
            step = RATE * plane_tree(g, h)
            m.pairs[k] += step
            z += step.ravel()[b]
    return m


def with_features(documents: DataFrame, text: str, keep: tuple[str | Column, ...]) -> DataFrame:
    def start() -> Callable[[list[str]], list[pa.Array]]:
        return lambda texts: [pa.array([features(t) for t in texts], pa.list_(pa.float64()))]

    return map_texts(documents, text, keep, start, "features array<double>")


def fit_quality(documents: DataFrame, labels: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", label: str = "quality", fit_rows: int = FIT_ROWS) -> Gam:
    """Learns from the labelled rows for which ``learn`` (a condition on the id) is true.

    About ``fit_rows`` labelled() ids at most are broadcast to the scan of the texts, and only their features come back, one row an
    id: both are of bounded size.
    """
    usable = labelled(labels.where(learn), doc_id, label, fit_rows).withColumn("_label", F.col("_label").cast("double"))
    rows = one_text_each(documents, usable, doc_id, text)
    got = sorted((r["_id"], r["_label"], r["features"]) for r in with_features(rows, "_text", ("_id", "_label")).collect())
    return fit_gam(np.array([f for _, _, f in got]).reshape(len(got), len(FEATURES)), np.array([y for _, y, _ in got]))


def classify(documents: DataFrame, model: Gam, text: str = "text", keep: tuple[str | Column, ...] = ("doc_id",), threshold: float = 0.3) -> DataFrame:
    """Adds score (the model's probability of label 1) and predicted (1 from ``threshold`` on) to the columns ``keep``.

    A null text counts as empty, and an empty one is scored like any other. Rows are independent: repeated rows give
    repeated results, an empty table an empty one; columns that aren't named, whatever their names, have no influence.
    """

    def start() -> Callable[[list[str]], list[pa.Array]]:
        def compute(texts: list[str]) -> list[pa.Array]:
            score = model.score(np.array([features(t) for t in texts]).reshape(len(texts), len(FEATURES)))
            return [pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]

        return compute

    return map_texts(documents, text, keep, start, "score double, predicted int")
