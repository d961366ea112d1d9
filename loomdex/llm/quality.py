"""Quality: a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins. Training cycles over
the features, and each time adds a shallow tree, fitted to the gradient over that
feature's bins, to its table; afterwards the pairs of features that explain most
of what is left get tables over pairs of bins in the same way. A score is a
sigmoid of a sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.labelled import held_out, training_rows

FEATURES = (
    "log_words", "word_length", "upper", "digit", "punctuation", "exclamation", "bar", "other_symbols",
    "non_ascii", "distinct_words", "distinct_lines", "words_per_line", "sentence_ends", "short_words", "spaces",
)
#: Parameters of training; MAX_ROWS bounds the labelled sample.
MAX_ROWS, BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 20_000, 32, 8, 6, 150, 60, 0.1

_ASCII = np.arange(256)
_UPPER, _DIGIT = (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 48) & (_ASCII <= 57)
_PUNCTUATION = np.isin(_ASCII, list(b",.;:!?'\"-()"))
_SYMBOL = np.isin(_ASCII, list(b"#$%&*+/<=>@[\\]^_`{|}~"))
_SPACE = np.isin(_ASCII, list(b" \t\n\v\f\r"))


def features(text: str | None) -> list[float]:
    """Numbers on the whole text, in the order of FEATURES; all of an empty text's are 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    if n == 0:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words, lines = raw.split(), raw.split(b"\n")
    m, inked = max(1, len(words)), max(1, n - int(counts[_SPACE].sum()))
    return [
        float(np.log1p(len(words))),
        inked / m,
        counts[_UPPER].sum() / inked,
        counts[_DIGIT].sum() / inked,
        counts[_PUNCTUATION].sum() / inked,
        counts[33] / m,
        counts[124] / m,
        (counts[_SYMBOL].sum() - counts[124]) / inked,
        counts[128:].sum() / inked,
        len(set(words)) / m,
        len(set(lines)) / len(lines),
        len(words) / len(lines),
        (counts[46] + counts[63]) / m,
        sum(map((4).__gt__, map(len, words))) / m,
        counts[_SPACE].sum() / n,
    ]


@dataclass
class Model:
    """Edges of each feature's bins, tables of features, tables of pairs."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, j], side="right")]
        for i, j, t in self.pairs:
            a, b = (np.searchsorted(self.pair_edges[k], x[:, k], side="right") for k in (i, j))
            total += t[a, b]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """The step of a tree with few leaves over ordered bins, from sums of gradient and hessian by bin."""
    out, parts = np.zeros(len(g)), [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for a, b in parts:
            if b - a < 2:
                continue
            gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            gt, ht = g[a:b].sum(), h[a:b].sum()
            win = _gain(gl, hl) + _gain(gt - gl, ht - hl) - _gain(gt, ht)
            k = int(win.argmax())
            if win[k] > best[0]:
                best = (win[k], (a, b), a + k + 1)
        if best[1] is None:
            break
        a, b = best[1]
        parts.remove((a, b))
        parts += [(a, best[2]), (best[2], b)]
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """The step of a tree of depth two over a grid of bins: a cut of one feature, then of the other on each side; and its gain."""
    best, out = 0.0, np.zeros_like(g)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, len(gg)):
            step, win = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[part].sum(axis=0), hh[part].sum(axis=0)
                step[part] = _tree(gs, hs, 2)
                values = step[part][0]
                win += float((2 * gs * values - hs * values * values).sum())
            if win > best:
                best, out = win, (step.T if flip else step)
    return out, best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables; without rows of both classes the score is near that class, 0 without rows."""
    y = np.asarray(y, float)
    n, k = x.shape
    edges, pair_edges = [_edges(x[:, j], BINS) if n else np.zeros(0) for j in range(k)], [_edges(x[:, j], PAIR_BINS) if n else np.zeros(0) for j in range(k)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    if n == 0 or y.min() == y.max():
        return Model(20.0 if n and y[0] == 1 else -20.0, edges, tables, pair_edges, [])
    share = y.mean()
    bias = float(np.log(share / (1 - share)))
    total = np.full(n, bias)
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j in range(k):
            g, h = residual()
            size = len(tables[j])
            step = RATE * np.clip(_tree(np.bincount(bins[j], g, size), np.bincount(bins[j], h, size)), -4, 4)
            tables[j] += step
            total += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(pair_edges)]
    sizes = [len(e) + 1 for e in pair_edges]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], v, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = residual()
    ranked = sorted(combinations(range(k), 2), key=lambda p: -_pair_tree(grid(*p, g), grid(*p, h))[1])
    pairs = [(i, j, np.zeros((sizes[i], sizes[j]))) for i, j in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for i, j, t in pairs:
            g, h = residual()
            step = RATE * np.clip(_pair_tree(grid(i, j, g), grid(i, j, h))[0], -4, 4)
            t += step
            total += step[coarse[i], coarse[j]]
    return Model(bias, edges, tables, pair_edges, pairs)


def matrix(texts: pd.Series) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_ROWS) -> Model:
    """Train on a bounded labelled sample; the driver gets the features, not the texts."""

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"d": rows["d"], "y": rows["y"], "x": list(matrix(rows["text"]))})

    rows = training_rows(docs, labels, label, max_rows)
    found = rows.mapInPandas(measured, "d long, y int, x array<double>").toPandas()
    x = np.array(found["x"].tolist(), float).reshape(len(found), len(FEATURES))
    order = np.lexsort((*x.T, found["d"].to_numpy()))
    return train(x[order], found["y"].to_numpy()[order])


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``; none for an empty table.

    Whole texts are scored; null counts as empty, and empty texts have a score like any other.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.value.scores(matrix(texts)))

    rows = docs.select("doc_id", held_out(docs["doc_id"]).alias("held_out"), quality(docs["text"]).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
