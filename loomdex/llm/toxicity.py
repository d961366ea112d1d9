"""Toxicity: bags of subword embeddings, averaged into a linear softmax.

A text counts as its set of words. A word's subwords are the word and its character n-grams, hashed to a fixed
number of buckets. A text's vector is the mean over its words of the mean of
their subword vectors; embeddings and softmax are trained jointly in numpy, so
misspelt words that were never seen still share n-gram vectors with known ones.
For two classes the score is a sigmoid of the mean over words of a number for
each word, so that scoring looks up a number for each word.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.labelled import held_out, training_rows
from loomdex.llm.words import Remembered

#: Fixed parameters of the model. A text counts as having SMOOTHING words more, of vector 0,
#: so that a very short text isn't judged by chance.
BUCKETS, DIMENSIONS, NGRAMS, SMOOTHING = 1 << 22, 4, (3, 4, 5, 6, 7), 10
#: Parameters of training; MAX_ROWS bounds the labelled sample. A bucket that is met in
#: fewer texts than MIN_TEXTS keeps the vector 0.
MAX_ROWS, MIN_TEXTS, EPOCHS, MOST_EPOCHS, BATCH, RATE, SCALE = 8000, 6, 10, 40, 32, 0.5, 100.0
#: Words whose number a worker remembers in each of two generations, and how long they may be.
CACHE_WORDS, CACHE_CHARS = 200_000, 64
#: Words of the sample whose subwords are made at a time.
BLOCK = 20_000

_WORD = re.compile(r"\w+")


def subwords(word: str) -> list[str]:
    """A word and its character n-grams with boundary marks."""
    marked = f"<{word}>"
    size = len(marked)
    return [marked, *[marked[i : i + n] for n in NGRAMS for i in range(size - n + 1)]]


def bucket(part: str) -> int:
    return crc32(part.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def words_of(text: str | None) -> set[str]:
    """Distinct words of the whole lower-cased text."""
    return set(_WORD.findall((text or "").lower()))


def train(bags: Iterable[list[str]], y: np.ndarray, seed: int = 1) -> tuple[dict[str, float], float]:
    """(number of each subword that is kept, bias) of a classifier of word bags.

    Trained by gradient descent; classes weigh alike. With rows of one class only, all scores
    are near that class; without rows, near 0.
    """
    y = np.asarray(y, np.int64)
    if len(y) == 0 or y.min() == y.max():
        return {}, 20.0 if len(y) and y[0] == 1 else -20.0
    number: dict[str, int] = {}
    docs = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for words in bags]
    texts = np.bincount(np.concatenate(docs).astype(np.int64), minlength=len(number))
    vocabulary = list(number)
    del number
    met, chunks = np.zeros(BUCKETS, np.int32), []
    for at in range(0, len(vocabulary), BLOCK):
        parts = [array("i", map(bucket, subwords(w))) for w in vocabulary[at : at + BLOCK]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = np.frombuffer(b"".join(parts), np.int32)
        met += np.bincount(flat, np.repeat(texts[at : at + BLOCK], sizes), BUCKETS).astype(np.int32)
        chunks.append((flat, sizes))
    kept = np.flatnonzero(met >= MIN_TEXTS)
    index = np.full(BUCKETS, -1, np.int32)
    index[kept] = np.arange(len(kept), dtype=np.int32)
    del met, parts
    size = np.concatenate([s for _, s in chunks])  # of all subwords; those kept are in flat
    held, live, masks = [], [], []
    while chunks:
        i, s = index[chunks[0][0]], chunks.pop(0)[1]
        masks.append(i >= 0)
        held.append(np.add.reduceat(masks[-1].astype(np.int64), np.cumsum(s) - s))
        live.append(i[masks[-1]])
    held, flat = np.concatenate(held), np.concatenate(live)
    start = np.cumsum(held) - held
    del live, index
    # Numbered by their first word: neighbours in memory are met together.
    by_word, first = np.unique(flat, return_index=True)
    by_word = by_word[np.argsort(first)]
    place = np.empty(len(kept), np.int32)
    place[by_word] = np.arange(len(kept), dtype=np.int32)
    flat = place[flat]
    counts = np.array([len(d) + SMOOTHING for d in docs], float)
    docs = [d[held[d] > 0] for d in docs]  # other words count, but are of vector 0

    rng = np.random.default_rng(seed)
    # Two dimensions make one complex number, so that memory is visited half as often.
    emb = np.ascontiguousarray(rng.normal(0, 0.02, (len(kept), DIMENSIONS))[by_word].view(complex).T)
    soft, bias = np.array(rng.normal(0, 0.5, (DIMENSIONS, 2))), np.zeros(2)
    weight = np.array([len(y) / (2 * (y == c).sum()) for c in (0, 1)])
    epochs = min(MOST_EPOCHS, max(EPOCHS, EPOCHS * MAX_ROWS // (2 * len(y))))
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            # Subwords are summed once for each distinct word of the batch.
            words, of_word = np.unique(np.concatenate([docs[i] for i in rows]), return_inverse=True)
            of_doc = np.repeat(np.arange(len(rows)), [len(docs[i]) for i in rows])
            sizes = held[words]
            first = np.cumsum(sizes) - sizes
            ids = flat[np.arange(sizes.sum()) + np.repeat(start[words] - first, sizes)]
            share, each = 1 / counts[rows][of_doc], SCALE / size[words]
            vectors = np.stack([np.add.reduceat(e[ids], first) * each for e in emb], axis=1).view(float)
            hidden = np.stack([np.bincount(of_doc, v[of_word] * share, len(rows)) for v in vectors.T], axis=1)
            logits = hidden @ soft + bias
            prob = np.exp(logits - logits.max(axis=1, keepdims=True))
            prob /= prob.sum(axis=1, keepdims=True)
            prob[np.arange(len(rows)), y[rows]] -= 1
            delta = prob * weight[y[rows], None] / len(rows)
            back = delta @ soft.T
            steps = np.stack([rate * each * np.bincount(of_word, b[of_doc] * share, len(words)) for b in back.T], axis=1)
            for e, step in zip(emb, steps.view(complex).T, strict=True):
                np.subtract.at(e, ids, np.repeat(step, sizes))
            soft -= rate * 0.1 * (hidden.T @ delta)
            bias -= rate * 0.1 * delta.sum(axis=0)
    value = SCALE * (np.ascontiguousarray(emb.T).view(float) @ (soft[:, 1] - soft[:, 0]))
    numbers: dict[str, float] = {}
    ends = np.cumsum(held).tolist()
    for n, mask in enumerate(masks):
        some = vocabulary[n * BLOCK : (n + 1) * BLOCK]
        parts = compress((p for w in some for p in subwords(w)), mask.tolist())
        numbers.update(zip(parts, value[flat[start[n * BLOCK] : ends[n * BLOCK + len(some) - 1]]].tolist(), strict=True))
    return numbers, float(bias[1] - bias[0])


class WordScores(Remembered):
    """Word to the mean of its subwords' numbers.

    It is broadcast itself: a worker remembers words from task to task, and forgets them and the model with the broadcast.
    """

    def __init__(self, numbers: dict[str, float]):
        self.numbers = numbers
        super().__init__(self._mean, CACHE_WORDS, CACHE_CHARS)

    def __reduce__(self):
        return WordScores, (self.numbers,)

    def _mean(self, word: str) -> float:
        parts = subwords(word)
        return sum(filter(None, map(self.numbers.get, parts))) / len(parts)


def score_text(text: str | None, words: WordScores, bias: float) -> float:
    values = list(map(words.__getitem__, words_of(text)))
    mean = math.fsum(values) / (len(values) + SMOOTHING)  # in any order of the set
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, mean + bias))))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_ROWS) -> tuple[dict[str, float], float]:
    """Train on a bounded labelled sample. The driver gets the distinct words of its texts."""

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows[["d", "y"]].assign(words=[" ".join(sorted(words_of(t))) for t in rows["text"]])

    rows = training_rows(docs, labels, label, max_rows)
    found = rows.mapInPandas(bags, "d long, y int, words string").toPandas().sort_values(["d", "words"])
    return train((w.split() for w in found["words"]), found["y"].to_numpy())


def scored(docs: DataFrame, model: tuple[dict[str, float], float], name: str = "score") -> DataFrame:
    """``docs`` and a column of scores of the whole texts; null counts as empty, and empty texts score the bias."""
    numbers, bias = model
    shared = docs.sparkSession.sparkContext.broadcast(WordScores(numbers))

    @F.pandas_udf("double")
    def toxicity(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        words = shared.value
        for texts in batches:
            yield pd.Series([score_text(t, words, bias) for t in texts], dtype="float64")

    return docs.withColumn(name, toxicity(docs["text"]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, a row for each row of ``docs``; none for an empty table.

    Rows that repeat a doc_id are scored each by its own text.
    """
    rows = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, training: DataFrame | None = None) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; columns as they are, whatever their names.

    The classifier learns from the labelled rows of ``training``, by default of ``docs``.
    """
    columns = [docs[c] for c in docs.columns]
    model = fit(docs if training is None else training, labels)
    kept = scored(docs.select(F.struct(*columns).alias("r"), docs["text"].alias("text")), model)
    return kept.where(F.col("score") < threshold).select("r.*")
