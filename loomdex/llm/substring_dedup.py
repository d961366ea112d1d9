"""Substring dedup by relative Lempel-Ziv parsing against all blocks of the table.

Documents are packed into blocks, whose words are the reference: a place is a block and the number of a word in it. The
index of all blocks tells, for each window of WINDOW words, the first place where it stands, by doc_id. A
document is parsed greedily into factors (block, position, length): the longest runs of words whose windows have
first places that follow each other, in documents of smaller doc_id. So each factor is a copy of its place, word by word.
Windows that lie across the borders of factors are looked up like any other, and make factors of their own, which may overlap
their neighbours: a passage copied from two places, or cut by a border, is found as well. Words of factors are duplicate spans.

The index is dealt by content. Each window has an anchor, the least hash of the GRAM-word runs in it: equal
windows have equal anchors, and neighbouring windows mostly share theirs. First, blocks send their distinct anchors, and learn
which ones another document has too. Then they send the windows at shared anchors, once for each block with the block's first place,
and learn the first place of each window that an earlier document has. Windows are alike if their hashes and their anchors are, 128 bits.

Words are hashed once, when blocks are packed; hashes stay with the blocks, which are written in buckets by their number, so that what is
learnt comes to them and texts aren't shuffled again. A window that very many documents hold is one entry a block; entries of one
content bucket are dealt into salted groups of at most FAN blocks, whose first places meet in a second round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.words import hashed, rolling
from loomdex.runtime import bucketed, materialize, partitions_for

WINDOW, GRAM = 13, 5
#: A block ends at so many documents or characters; a longer document is a block of its own.
BLOCK_DOCS, BLOCK_CHARS = 1024, 2_000_000
#: Entries that one content bucket holds, about, and blocks that meet in one group of it.
BUCKET_ENTRIES, FAN = 750_000, 16_384
#: Bytes of stored input for each bucket of blocks.
STORED = 4 << 20

_LAST = 2**63 - 1  # stands for a null doc_id: after all others


def _bytes(column, kind) -> list[np.ndarray]:
    return [np.frombuffer(b, kind) for b in column]


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def block_table(docs: DataFrame) -> DataFrame:
    """``(block, ids, none, texts, n_chars, sizes, hashes)``: all documents in blocks, by doc_id within each; hashes of all words."""
    schema = "block long, ids array<long>, none array<boolean>, texts array<string>, n_chars long"
    columns = [c.split()[0] for c in schema.split(", ")]

    def packed(block: int, held: list[tuple]) -> pd.DataFrame:
        held.sort(key=lambda r: r[0])
        ids, none, texts = zip(*held, strict=True)
        return pd.DataFrame([(block, list(ids), list(none), list(texts), sum(map(len, texts)))], columns=columns)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, held, chars = TaskContext.get().partitionId() << 33, [], 0
        for rows in batches:
            for row in zip(rows["id"].tolist(), rows["no_id"].tolist(), rows["text"], strict=True):
                if held and (len(held) >= BLOCK_DOCS or chars + len(row[2]) > BLOCK_CHARS):
                    yield packed(n, held)
                    n, held, chars = n + 1, [], 0
                held.append(row)
                chars += len(row[2])
        if held:
            yield packed(n, held)

    def hash_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for at in range(len(rows)):
                row = rows.iloc[at : at + 1]
                words = [t.encode("utf-8", "surrogatepass").split() for t in row["texts"].iloc[0]]
                sizes = np.fromiter(map(len, words), np.int32, len(words))
                yield row.assign(sizes=[sizes.tobytes()], hashes=[hashed(chain.from_iterable(words), int(sizes.sum())).tobytes()])

    rows = docs.select(
        F.coalesce(docs["doc_id"], F.lit(_LAST)).alias("id"),
        docs["doc_id"].isNull().alias("no_id"),
        F.coalesce(docs["text"], F.lit("")).alias("text"),
    )
    # Hashes are made where blocks come to lie: texts alone are shuffled.
    with_hashes = lambda df: df.mapInPandas(hash_words, f"{schema}, sizes binary, hashes binary")
    return bucketed(rows.mapInPandas(pack, schema), "block", partitions_for(docs, STORED), "blocks", with_hashes)


def anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window: the least hash of its runs of GRAM words, mixed."""
    g = rolling(hashes, GRAM)
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    least, width, span = g, 1, WINDOW - GRAM + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    out = least * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def _dealt(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(bucket, its part of each column)."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    stop = np.r_[start[1:], len(bucket)] if len(bucket) else []
    for a, z in zip(start, stop, strict=True):
        yield int(bucket[a]), *(c[a:z] for c in columns)


def _told(rows, *kinds) -> dict[int, list[np.ndarray]]:
    """What a block was told of each bucket, rows of one bucket together."""
    out: dict[int, list] = {}
    for row in rows if rows is not None else ():
        out.setdefault(row["bucket"], []).append([np.frombuffer(row[name], kind) for name, kind in kinds])
    return {b: [np.concatenate(c) for c in zip(*parts, strict=True)] for b, parts in out.items()}


class Block:
    """The windows of a block: their first words, documents, anchors and hashes."""

    def __init__(self, ids, sizes: bytes, hashes: bytes, buckets: int):
        self.ids, self.buckets = np.array(ids, np.int64), np.uint64(buckets)
        self.sizes, found = np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(hashes, np.uint64)
        # One array for the whole block; windows that reach over the end of a document are left out.
        counts = np.maximum(0, self.sizes - WINDOW + 1)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.doc = np.repeat(np.arange(len(self.ids)), counts)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(counts) - counts - self.first, counts)
        some = len(self.at) > 0
        self.anchor = anchors(found)[self.at] if some else np.zeros(0, np.uint64)
        self.window = rolling(found, WINDOW)[self.at] if some else np.zeros(0, np.uint64)

    def keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, sorted distinct anchors, whether several documents have it)."""
        if not len(self.anchor):
            return
        new = np.r_[True, (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1])]
        a, d = self.anchor[new], self.doc[new]
        b = (a % self.buckets).astype(np.int64)
        order = np.lexsort((a, b))
        a, d, b = a[order], d[order], b[order]
        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        several = np.maximum.reduceat(d, first) != np.minimum.reduceat(d, first)
        yield from _dealt(b[first], a[first], several)

    def entries(self, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(windows at shared anchors, entry of each, first window of each entry, bucket of each entry).

        An entry is a distinct window; entries are in order of bucket, anchor and hash.
        """
        told, none = _told(shared, ("idx", np.int32)), np.zeros(0, np.int64)
        kept = np.sort(_joined([a[told[b][0]] for b, a, _ in self.keys() if b in told], np.uint64))
        if not len(kept):
            return none, none, none, none
        near = np.minimum(np.searchsorted(kept, self.anchor), len(kept) - 1)
        live = np.flatnonzero(kept[near] == self.anchor)
        a, h = self.anchor[live], self.window[live]
        b = (a % self.buckets).astype(np.int64)
        order = np.lexsort((h, a, b))  # stable: of equal windows that of the least doc_id is first
        a, h, live = a[order], h[order], live[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (a[1:] != a[:-1])]
        return live, np.cumsum(new) - 1, live[new], b[order][new]

    def sources(self, block: int, shared, answers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: whether an earlier document has it, and the block and word where it stands first."""
        hit, of_block, of_word = np.zeros(len(self.at), bool), np.zeros(len(self.at), np.int64), np.zeros(len(self.at), np.int64)
        live, entry, first, bucket = self.entries(shared)
        if not len(live):
            return hit, of_block, of_word
        known, places, words = np.zeros(len(first), bool), np.full(len(first), block, np.int64), self.at[first].copy()
        for b, (idx, source, position) in _told(answers, ("idx", np.int32), ("source", np.int64), ("position", np.int32)).items():
            e = np.searchsorted(bucket, b) + idx
            known[e], places[e], words[e] = True, source, position
        least = self.ids[self.doc[first]]
        hit[live] = known[entry] | (least[entry] < self.ids[self.doc[live]])
        of_block[live], of_word[live] = places[entry], words[entry]
        return hit, of_block, of_word


def factors(hit: np.ndarray, block: np.ndarray, word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first window, windows) of each factor: greedily, the longest runs of windows of a document at places that follow each other."""
    if not hit.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = hit[1:] & hit[:-1] & (doc[1:] == doc[:-1]) & (block[1:] == block[:-1]) & (word[1:] == word[:-1] + 1)
    start = np.flatnonzero(hit & ~np.r_[False, goes_on])
    end = np.flatnonzero(hit & ~np.r_[goes_on, False])
    return start, end - start + 1


_SHARED = "block long, bucket int, idx binary, final boolean, keys binary, several binary"
_FIRST = "block long, bucket int, idx binary, source binary, position binary, final boolean, anchors binary, windows binary, owners binary, places binary"
_SENT = ("anchors", np.uint64), ("windows", np.uint64), ("owners", np.int64), ("places", np.int32)


def _numbers(rows: pd.DataFrame, sizes: list[int]) -> np.ndarray:
    """The number of each entry within its message: as told in a second round, else in order."""
    return np.concatenate([np.frombuffer(i, np.int32) if i else np.arange(n, dtype=np.int32) for i, n in zip(rows["idx"], sizes, strict=True)])


def _shared(last: bool):
    """Which anchors several documents have, as numbers within each message; before the last round, an entry of each anchor goes on."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "bucket"])
        keys, again = _bytes(rows["keys"], np.uint64), rows["idx"].map(len).gt(0).any()
        sizes = list(map(len, keys))
        every, many, idx = np.concatenate(keys), np.concatenate(_bytes(rows["several"], bool)), _numbers(rows, sizes)
        _, first, group = np.unique(every, return_index=True, return_inverse=True)
        shared = np.bincount(group, 1 + many)[group] > 1
        goes_on = np.zeros(len(every), bool)
        goes_on[first] = not last
        yes, out = shared & ~many if again else shared, []  # who was told in the first round isn't told again
        for block, bucket, z, n in zip(rows["block"], rows["bucket"], np.cumsum(sizes), sizes, strict=True):
            part = slice(z - n, z)
            told, more = yes[part], goes_on[part]
            if told.any():
                out.append((block, bucket, idx[part][told].tobytes(), True, b"", b""))
            if more.any():
                out.append((block, bucket, idx[part][more].tobytes(), False, every[part][more].tobytes(), shared[part][more].tobytes()))
        return pd.DataFrame(out, columns=["block", "bucket", "idx", "final", "keys", "several"])

    return run


def _first(last: bool):
    """The first place of each window that an earlier document has: (number within the message, block, word).

    Before the last round, entries of a window's least doc_id here go on to it.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "bucket"])
        cols = [_bytes(rows[name], kind) for name, kind in _SENT]
        sizes = list(map(len, cols[0]))
        anchor, window, owner, place = map(np.concatenate, cols)
        idx, blocks, out = _numbers(rows, sizes), rows["block"].to_numpy(), []
        message = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((owner, window, anchor))  # stable: of one doc_id the least block is first
        a, h = anchor[order], window[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (a[1:] != a[:-1])]
        best = np.empty(len(order), np.int64)
        best[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        later = owner[best] < owner
        for block, bucket, z, n in zip(rows["block"], rows["bucket"], np.cumsum(sizes), sizes, strict=True):
            part = slice(z - n, z)
            yes = later[part]
            if yes.any():
                of = best[part][yes]
                out.append((block, bucket, idx[part][yes].tobytes(), blocks[message[of]].astype(np.int64).tobytes(), place[of].tobytes(), True, b"", b"", b"", b""))
            if not last and not yes.all():
                out.append((block, bucket, idx[part][~yes].tobytes(), b"", b"", False, *(c[part][~yes].tobytes() for c in (anchor, window, owner, place))))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _FIRST.split(", ")])

    return run


def _rounds(sent: DataFrame, meet, schema: str, salts: int, name: str, *keep: str) -> DataFrame:
    """What ``meet`` tells the messages of each bucket: in one round, or by salted groups of blocks in two."""
    first = sent.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")).withColumn("idx", F.lit(b""))
    told = materialize(first.groupBy("bucket", "salt").applyInPandas(meet(salts == 1), schema), name)
    out = told.where("final").select("block", "bucket", *keep)
    if salts == 1:
        return out
    again = told.where("not final").groupBy("bucket").applyInPandas(meet(True), schema)
    return out.unionByName(materialize(again, f"{name}_again").select("block", "bucket", *keep))


def _with(blocks: DataFrame, told: DataFrame, name: str, *columns: str) -> DataFrame:
    """Blocks with what they were told, as a list: that is shuffled to the blocks, which stay in their buckets."""
    listed = told.groupBy(F.col("block").alias(f"{name}_block")).agg(F.collect_list(F.struct("bucket", *columns)).alias(name))
    return blocks.join(listed.hint("shuffle_hash"), blocks["block"] == listed[f"{name}_block"], "left").drop(f"{name}_block")


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_removed, factors, kept_text)``, a row for each row of ``docs(doc_id, text)``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; null text has none. Each word is removed that lies in
    a window of 13 words which also starts in a document of smaller doc_id, as the input has
    them; factors lists (first word, number of words, block, position) of what is removed and where it stands first,
    kept_text is the other words, joined by a space. Rows of one doc_id never remove each other's words; null
    doc_ids come after all others. Texts of fewer than 13 words keep all. An empty table gives no rows; other columns are left out.
    """
    return parsed(block_table(docs))


def parsed(blocks: DataFrame) -> DataFrame:
    """As :func:`dedup_substrings`, of a table of blocks."""
    stats = blocks.agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"), F.count("*").alias("blocks")).first()
    buckets, salts = max(8, math.ceil(stats["chars"] / 24 / BUCKET_ENTRIES)), max(1, math.ceil(stats["blocks"] / FAN))

    def send_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, ids, sizes, hashes in zip(rows["block"], rows["ids"], rows["sizes"], rows["hashes"], strict=True):
                sent = Block(ids, sizes, hashes, buckets).keys()
                yield pd.DataFrame([(block, b, a.tobytes(), s.tobytes()) for b, a, s in sent], columns=["block", "bucket", "keys", "several"])

    bare = blocks.select("block", "ids", "sizes", "hashes")
    keys = bare.mapInPandas(send_keys, "block long, bucket int, keys binary, several binary")
    shared = _rounds(keys, _shared, _SHARED, salts, "shared", "idx")

    def send_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, ids, sizes, hashes, told in zip(rows["block"], rows["ids"], rows["sizes"], rows["hashes"], rows["shared"], strict=True):
                b = Block(ids, sizes, hashes, buckets)
                _, _, first, bucket = b.entries(told)
                columns = b.anchor[first], b.window[first], b.ids[b.doc[first]], b.at[first].astype(np.int32)
                out = [(block, number, *(c.tobytes() for c in parts)) for number, *parts in _dealt(bucket, *columns)]
                yield pd.DataFrame(out, columns=["block", "bucket", *(name for name, _ in _SENT)])

    schema = "block long, bucket int, anchors binary, windows binary, owners binary, places binary"
    windows = _with(bare, shared, "shared", "idx").mapInPandas(send_windows, schema)
    answers = _rounds(windows, _first, _FIRST, salts, "first", "idx", "source", "position")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for block, ids, none, texts, sizes, hashes, told, answered in rows.itertuples(index=False):
                b = Block(ids, sizes, hashes, buckets)
                hit, of_block, of_word = b.sources(block, told, answered)
                start, windows = factors(hit, of_block, of_word, b.doc)
                total = int(b.sizes.sum())
                edge = np.bincount(b.at[start], minlength=total + 1) - np.bincount(b.at[start] + windows + WINDOW - 1, minlength=total + 1)
                gone = np.cumsum(edge)[:total] > 0
                of_doc = np.searchsorted(b.doc[start], np.arange(len(ids) + 1))
                out = []
                for d, text in enumerate(texts):
                    words, mine = text.encode("utf-8", "surrogatepass").split(), range(of_doc[d], of_doc[d + 1])
                    lost = gone[b.first[d] : b.first[d] + len(words)]
                    kept = [w for w, g in zip(words, lost.tolist(), strict=True) if not g] if mine else words
                    spans = [
                        {"first": int(b.at[start[f]] - b.first[d]), "words": int(windows[f] + WINDOW - 1), "block": int(of_block[start[f]]), "position": int(of_word[start[f]])}
                        for f in mine
                    ]
                    out.append((len(words), int(lost.sum()), spans, b" ".join(kept).decode("utf-8", "surrogatepass")))
                frame = pd.DataFrame(out, columns=["n_words", "n_removed", "factors", "kept_text"])
                frame.insert(0, "id", np.array(ids, np.int64))
                frame.insert(1, "no_id", np.array(none, bool))
                yield frame

    whole = blocks.select("block", "ids", "none", "texts", "sizes", "hashes")
    told = _with(_with(whole, shared, "shared", "idx"), answers, "answers", "idx", "source", "position")
    schema = "id long, no_id boolean, n_words long, n_removed long, factors array<struct<first:int,words:int,block:long,position:int>>, kept_text string"
    out = told.mapInPandas(parse, schema)
    doc_id = F.when(~F.col("no_id"), F.col("id")).alias("doc_id")
    return out.select(doc_id, "n_words", "n_removed", "factors", "kept_text")
