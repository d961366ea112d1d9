"""SentencePiece encoding and decoding; giant documents by a max-plus parallel scan.

Documents up to GIANT characters are segmented where they are read. A giant one is
split into chunks of CHUNK characters, wherever that falls. What the Viterbi recursion
carries over a border are the best scores at the last L positions, L being the
longest piece; a chunk acts on them as an L by L matrix in the (max, +) semiring.

1. Each chunk's matrix is made by itself.
2. Matrices of a document are combined associatively, which gives the scores at each border.
3. Each chunk, given the scores at its left border, tells for each position at its right
   border where the best path came in; these maps are composed from the right.
4. Each chunk, now knowing where the path leaves it, is traced back by itself.

Only numbers per border leave the chunks in steps 2 and 3. Between two cuts, places that no
piece reaches across, a chunk's pieces don't depend on its borders at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.token_count import read_model
from loomdex.llm.unigram import Segmenter, segmenter
from loomdex.runtime import materialize

#: Documents of more characters are split into chunks of so many.
GIANT, CHUNK = 65_536, 32_768
#: Rows that a worker sends back at once.
ROWS = 256

#: No path.
NEVER = -(1 << 60)


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (max, +) product of two transfer matrices, or of a vector and a matrix."""
    if a.ndim == 1:
        return np.maximum((a[:, None] + b).max(axis=0), NEVER)
    return np.maximum((a[:, :, None] + b[None, :, :]).max(axis=1), NEVER)


def scan(parts: list[np.ndarray]) -> list[np.ndarray]:
    """All prefix products, by the tree of an associative scan."""
    if len(parts) <= 1:
        return parts
    pairs = scan([combine(parts[i], parts[i + 1]) for i in range(0, len(parts) - 1, 2)])
    out = [parts[0]]
    for i in range(1, len(parts)):
        out.append(pairs[i // 2] if i % 2 else combine(pairs[i // 2 - 1], parts[i]))
    return out


class Chunk:
    """A chunk: ``left`` characters before its border, its body; state i is position left - (L - 1) + i.

    At its right border, state j is position n - (L - 1) + j, n being the length of both.
    """

    def __init__(self, segmenter: Segmenter, text: str, left: int):
        self.s, self.text, self.left, self.n = segmenter, text, left, len(text)
        self.size = segmenter.vocabulary.longest
        # First and last cut inside of the body; between them nothing depends on the borders.
        self.first = next((p for p in range(left + 1, self.n) if segmenter.is_cut(text, p)), None)
        self.last = next((p for p in range(self.n - 1, left, -1) if segmenter.is_cut(text, p)), None)

    def _entry(self, state: int) -> int:
        return self.left - (self.size - 1) + state

    def _exit(self, state: int) -> int:
        return self.n - (self.size - 1) + state

    def _middle(self) -> list[int]:
        out: list[int] = []
        for word in self.s.between.findall(self.text[self.first : self.last]):
            out.extend(self.s.word_ids(word))
        return out

    def _score(self, text: str) -> int:
        total = 0
        for word in self.s.between.findall(text):
            best, _, _ = self.s.forward(word)
            total += best[len(word)]
        return total

    def _tail(self):
        """Scores, back and pieces from the last cut on."""
        return self.s.forward(self.text[self.last :])

    def matrix(self) -> np.ndarray:
        out = np.full((self.size, self.size), NEVER, np.int64)
        to = self.first if self.first is not None else self.n
        rows = {}
        for state in range(self.size):
            at = self._entry(state)
            if at >= 0:
                rows[state] = self.s.forward(self.text[:to], {at: 0}, self.left)[0]
        if self.first is None:
            for state, best in rows.items():
                for j in range(self.size):
                    end = self._exit(j)
                    if end > self.left and best[end] is not None:
                        out[state, j] = best[end]
            return out
        middle, tail = self._score(self.text[self.first : self.last]), self._tail()[0]
        for state, best in rows.items():
            if best[to] is None:
                continue
            for j in range(self.size):
                end = self._exit(j) - self.last
                if end >= 0 and tail[end] is not None:
                    out[state, j] = best[to] + middle + tail[end]
        return out

    def _head(self, scores: np.ndarray):
        to = self.first if self.first is not None else self.n
        start = {self._entry(i): int(v) for i, v in enumerate(scores) if self._entry(i) >= 0 and v > NEVER // 2}
        return to, self.s.forward(self.text[:to], start, self.left)

    def entries(self, scores: np.ndarray) -> np.ndarray:
        """For each exit state, the state at which its best path entered, or -1."""
        to, (best, back, piece) = self._head(scores)
        out = np.full(self.size, -1, np.int32)
        for j in range(self.size):
            end = to if self.first is not None else self._exit(j)
            if end > self.left and best[end] is not None:
                at, _ = self.s.path(self.text[:to], back, piece, end, self.left)
                out[j] = at - self.left + self.size - 1
        return out

    def ids(self, scores: np.ndarray, leave: int) -> list[int]:
        """Ids of the pieces that end in this chunk, for the path that leaves it at a state."""
        to, (_, back, piece) = self._head(scores)
        head = self.text[:to]
        end = to if self.first is not None else self._exit(leave)
        out = self.s.ids_of(head, self.s.path(head, back, piece, end, self.left)[1])
        if self.first is not None:
            out += self._middle()
            _, back, piece = self._tail()
            tail = self.text[self.last :]
            out += self.s.ids_of(tail, self.s.path(tail, back, piece, self._exit(leave) - self.last)[1])
        return out


def _split(text: str, size: int, longest: int) -> Iterator[tuple[int, str, int]]:
    """(number, text with left context, its length) of each chunk; the last one is up to twice as long."""
    count = max(1, len(text) // size)
    for c in range(count):
        a, z = c * size, len(text) if c == count - 1 else (c + 1) * size
        left = min(a, longest - 1)
        yield c, text[a - left : z], left


def _giants(docs: DataFrame, shared, chunk: int) -> DataFrame:
    """(doc_id, ids) of giant documents."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, uid = segmenter(shared.value), TaskContext.get().partitionId() << 33
        for rows in batches:
            for doc, none, text in zip(rows["id"], rows["no_id"], rows["text"], strict=True):
                for c, part, left in _split(s.prefixed(text), chunk, s.vocabulary.longest):
                    yield pd.DataFrame({"uid": [uid], "id": [doc], "no_id": [none], "c": [c], "part": [part], "left": [left]})
                uid += 1

    schema = "uid long, id long, no_id boolean, c int, part string, left int"
    chunks = materialize(docs.mapInPandas(split, schema), "chunks")
    if chunks.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, ids array<int>")

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = segmenter(shared.value)
        for rows in batches:
            made = [Chunk(s, p, n).matrix().tobytes() for p, n in zip(rows["part"], rows["left"], strict=True)]
            yield pd.DataFrame({"uid": rows["uid"], "c": rows["c"], "m": made})

    def borders(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        parts = [np.frombuffer(m, np.int64) for m in rows["m"]]
        size = int(len(parts[0]) ** 0.5)
        start = np.full(size, NEVER, np.int64)
        start[-1] = 0
        scores = [start, *(combine(start, m) for m in scan([p.reshape(size, size) for p in parts[:-1]]))]
        return pd.DataFrame({"uid": rows["uid"], "c": rows["c"], "scores": [v.tobytes() for v in scores]})

    made = chunks.select("uid", "c", "part", "left").mapInPandas(matrices, "uid long, c int, m binary")
    scores = materialize(made.groupBy("uid").applyInPandas(borders, "uid long, c int, scores binary"), "scores")

    def enter(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = segmenter(shared.value)
        for rows in batches:
            found = [
                Chunk(s, p, n).entries(np.frombuffer(v, np.int64)).tobytes()
                for p, n, v in zip(rows["part"], rows["left"], rows["scores"], strict=True)
            ]
            yield pd.DataFrame({"uid": rows["uid"], "c": rows["c"], "e": found})

    def leave(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("c")
        maps = [np.frombuffer(e, np.int32) for e in rows["e"]]
        out = [len(maps[0]) - 1]
        for m in maps[:0:-1]:
            out.append(int(m[out[-1]]))
        return pd.DataFrame({"uid": rows["uid"], "c": rows["c"], "leave": out[::-1]})

    met = chunks.join(scores, ["uid", "c"])
    entered = met.select("uid", "c", "part", "left", "scores").mapInPandas(enter, "uid long, c int, e binary")
    leaves = materialize(entered.groupBy("uid").applyInPandas(leave, "uid long, c int, leave int"), "leaves")

    def trace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = segmenter(shared.value)
        for rows in batches:
            ids = [
                np.array(Chunk(s, p, n).ids(np.frombuffer(v, np.int64), z), np.int32)
                for p, n, v, z in zip(rows["part"], rows["left"], rows["scores"], rows["leave"], strict=True)
            ]
            yield rows[["uid", "id", "no_id", "c"]].assign(ids=ids)

    traced = met.join(leaves, ["uid", "c"]).mapInPandas(trace, "uid long, id long, no_id boolean, c int, ids array<int>")
    whole = traced.groupBy("uid", "id", "no_id").agg(F.array_sort(F.collect_list(F.struct("c", "ids"))).alias("s"))
    return whole.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), F.flatten("s.ids").alias("ids"))


def encode(docs: DataFrame, model: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, ids array<int>)``, a row for each row of ``docs(doc_id, text)``.

    Ids of the best unigram segmentation of the whole text with the model's pieces and scores; empty or null
    text has none. An empty table gives no rows; rows that repeat are encoded each.
    """
    return round_trip(docs, model, giant, chunk).select("doc_id", "ids")


def round_trip(docs: DataFrame, model: bytes | None = None, giant: int = GIANT, chunk: int = CHUNK) -> DataFrame:
    """As :func:`encode`, and ``text`` as :func:`decode` makes it of the ids, in the same pass over the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(model or read_model())

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = segmenter(shared.value)
        for rows in batches:
            for at in range(0, len(rows), ROWS):  # small batches back: ids take more room than texts
                part = rows.iloc[at : at + ROWS]
                ids = [np.frombuffer(s.encode_packed(t), np.int32) for t in part["text"]]
                yield pd.DataFrame({"id": part["id"], "no_id": part["no_id"], "ids": ids, "text": list(map(s.decode, ids))})

    rows = docs.select(
        F.coalesce(docs["doc_id"], F.lit(0)).alias("id"),
        docs["doc_id"].isNull().alias("no_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    small = rows.where(F.length("text") <= giant).mapInPandas(coded, "id long, no_id boolean, ids array<int>, text string")
    small = small.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "ids", "text")
    return small.unionByName(decode(_giants(rows.where(F.length("text") > giant), shared, chunk), model))


def decode(encoded: DataFrame, model: bytes | None = None) -> DataFrame:
    """``encoded(doc_id, ids, ...)`` and the decoded ``text``: as it was, but U+2581 comes back as a space; null ids as empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or read_model())

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = segmenter(shared.value).decode
        for ids in batches:
            yield pd.Series([run(i if i is not None else ()) for i in ids], dtype=object)

    return encoded.withColumn("text", text_of(encoded["ids"]))
