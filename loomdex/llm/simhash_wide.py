"""Near-duplicates of a given similarity, by SimHash fingerprints wide enough to tell it.

64 bits tell nearly equal texts only: at a Jaccard similarity of 0.8 over word shingles,
fingerprints differ in about 15% of their bits. Here a text has BITS bits over its set of
shingles. Two sets of similarity s differ in a share arccos(2s / (1 + s)) / pi of them, which
gives the expected distance. Signatures that differ in up to SIGMAS standard deviations more are candidates only: texts are
linked if their sets of shingles, compared themselves, are of the similarity or more.

The index is multi-index hashing again: SEGMENTS segments of 16 bits, half of them of the bits in another order. The highest EXACT
bits of a segment must agree, while the Hamming ball of radius 1 over the others is looked up;
complete distances of all that is met are verified. What is found of a pair depends on the two signatures alone, not on how many
there are: their number only decides how many of the exact bits name a part of the index. Within a part, each link that connects
nothing new is left out, so that a dense group gives as many links as it has members. A part
with very many members is dealt into blocks, and each two blocks meet in a task of their own.

Candidates' components are then verified, each text being read once: in a component all pairs of near signatures are compared
that nothing connects yet. A large component is dealt into chunks, which share its root; what that doesn't connect
to the component's main group meets all members, in tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.components import connected_components
from loomdex.llm.rows import keep_chosen, row_key
from loomdex.llm.simhash import first_rows
from loomdex.llm.words import hashed, rolling
from loomdex.runtime import materialize

BITS, SEGMENTS, EXACT = 384, 48, 9
#: Members of a part, about, and of a block of a hot one.
PART, BLOCK = 25_000, 20_000
#: Pairs that are compared at once.
PAIRS = 1 << 20
#: Shingles whose bits are summed at once.
SUMMED = 1 << 13
#: A candidate may differ by so many standard deviations more than expected at the similarity asked for.
SIGMAS = 3
#: Members of a component, or of small components together, about, that are verified in one task.
VERIFIED = 500

_MIX = np.random.default_rng(384).integers(1, 2**63, BITS // 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
#: Bits of the segments, in two orders.
_ORDERS = [np.arange(BITS), np.random.default_rng(48).permutation(BITS)]


def farthest(similarity: float) -> int:
    """The greatest distance of a candidate."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(BITS * share + SIGMAS * math.sqrt(BITS * share * (1 - share)))


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the set of word shingles, A-Z lower-cased; one of all words if there are fewer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return np.unique(rolling(hashed(words, len(words)), min(shingle, len(words)))) if words else np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """BITS bits; all 0 without shingles."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), SUMMED):
        h = shingles[at : at + SUMMED, None] * _MIX
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return np.packbits((2 * ones > len(shingles)).astype(np.uint8), bitorder="little").tobytes()


class _Forest:
    """Union-find over the members of a part."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """Those of the links that connect something new."""
        out, root = [], {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                x = y
            return x

        for i, j, p, q in zip(a.tolist(), b.tolist(), self.label[a].tolist(), self.label[b].tolist(), strict=True):
            p, q = find(p), find(q)
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((i, j))
        if out:
            old = np.array(sorted(root))
            new = np.array([find(x) for x in old.tolist()])
            at = np.minimum(np.searchsorted(old, self.label), len(old) - 1)
            self.label = np.where(old[at] == self.label, new[at], self.label)
        return out


def segments_of(signatures: np.ndarray) -> np.ndarray:
    """The SEGMENTS segments of signatures, a row of bytes each."""
    bits = np.unpackbits(signatures, axis=1, bitorder="little")
    return np.hstack([np.ascontiguousarray(np.packbits(bits[:, o], axis=1, bitorder="little")).view(np.uint16) for o in _ORDERS])


def _links_of(distance: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        t, pair = int(rows["t"].iloc[0]), bool(rows["x"].iloc[0] != rows["y"].iloc[0])
        v = rows["v"].to_numpy()
        sig = np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(len(rows), -1)
        side = (rows["b"] == rows["x"]).to_numpy()
        key = segments_of(sig.view(np.uint8))[:, t].astype(np.int64)
        order = np.argsort(key, kind="stable")
        v, sig, side, key = v[order], sig[order], side[order], key[order]
        start = np.searchsorted(key, np.arange((1 << 16) + 1))
        forest, out = _Forest(len(v)), []
        for flip in (0, *(1 << b for b in range(16 - EXACT))):
            probe = key ^ flip
            first = np.where(flip == 0, np.arange(len(v)) + 1, start[probe])
            many = np.maximum(0, start[probe + 1] - first)
            if flip:
                many[probe < key] = 0  # each pair once
            ends = np.cumsum(many)
            at = 0
            while at < len(v):
                done = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
                n = many[at:to]
                i = np.repeat(np.arange(at, to), n)
                j = np.repeat(first[at:to] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                new = forest.label[i] != forest.label[j]
                if pair:
                    new &= side[i] != side[j]
                i, j = i[new], j[new]
                near = np.bitwise_count(sig[i, :3] ^ sig[j, :3]).sum(axis=1) <= distance  # half of the words first
                i, j = i[near], j[near]
                near = np.bitwise_count(sig[i] ^ sig[j]).sum(axis=1) <= distance
                out += forest.add(i[near], j[near])
                at = to
        links = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": v[links[:, 0]], "v": v[links[:, 1]]})

    return run


def similar_signatures(signatures: DataFrame, similarity: float) -> DataFrame:
    """Links ``(u, v)`` of distinct ``signatures(v long, sig binary)`` that connect all candidates found."""
    high = min(EXACT, max(0, math.ceil(math.log2(max(1, signatures.count()) / PART))))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            segments = segments_of(np.frombuffer(b"".join(rows["sig"]), np.uint8).reshape(len(rows), -1))
            for t in range(SEGMENTS):
                yield pd.DataFrame({"t": t, "r": (segments[:, t] >> (16 - high)).astype(np.int32) if high else np.int32(0), "v": rows["v"], "sig": rows["sig"]})

    placed = signatures.mapInPandas(place, "t int, r int, v long, sig binary")
    sizes = materialize(placed.groupBy("t", "r").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    dealt = placed.join(sizes, ["t", "r"]).withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("t", "r", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "v", "sig")
    return met.groupBy("t", "r", "x", "y").applyInPandas(_links_of(farthest(similarity)), "u long, v long")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sets, as sorted arrays, is that or more."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both) >= similarity


def _verified_of(similarity: float, shingle: int):
    distance = farthest(similarity)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """Links of rows of one component to those that are met, where labels differ; each that connects nothing new is left out."""
        out = []
        for _, part in rows.groupby("comp", sort=False):
            part = part.sort_values(["v", "rest"])  # the root first
            v, rest, label = part["v"].to_numpy(), part["rest"].to_numpy(), part["label"].to_numpy().copy()
            sig = np.frombuffer(b"".join(part["sig"]), np.uint64).reshape(len(part), -1)
            sets = [shingle_set(t, shingle) for t in part["text"]]
            tile = bool(rest.any())
            met = np.flatnonzero(~rest)
            for i in np.flatnonzero(rest) if tile else range(len(part)):
                j = met if tile else np.arange(i + 1, len(part))
                j = j[label[j] != label[i]]
                for k in j[np.bitwise_count(sig[j] ^ sig[i]).sum(axis=1) <= distance].tolist():
                    if label[k] != label[i] and alike(sets[i], sets[k], similarity):
                        out.append((v[i], v[k]))
                        label[label == label[k]] = label[i]
        links = np.array(out, np.int64).reshape(-1, 2)
        return pd.DataFrame({"u": links[:, 0], "v": links[:, 1]})

    return run


def verified_links(members: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links ``(u, v)`` that connect all texts of the similarity or more within components of candidates.

    ``members(v, comp, sig, h)`` are distinct sets of shingles, comp being the least v of a component; ``texts(h, text)`` may repeat.
    """
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("chunks"))
    bins = max(1, math.ceil(members.count() / VERIFIED))
    small = F.col("chunks") == 1
    dealt = members.join(sizes, "comp").select(
        "comp", "v", "sig", "h", "chunks",
        F.when(small, -1 - F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.col("comp")).alias("k"),
        F.when(small, 0).otherwise(F.pmod(F.xxhash64("v"), F.col("chunks"))).cast("int").alias("c"),
    )
    # Texts of one hash are equal: one of them is read.
    first = dealt.join(texts, "h").groupBy("v").agg(F.first("text").alias("text"), *[F.first(c).alias(c) for c in ("comp", "sig", "chunks", "k", "c")])
    dealt = materialize(first, "members")
    run, link = _verified_of(similarity, shingle), "u long, v long"
    shared = F.when(F.col("v") == F.col("comp"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("c"))
    star = dealt.select("comp", "k", F.explode(shared).alias("c"), "v", "sig", "text", F.col("v").alias("label"), F.lit(False).alias("rest"))
    links = materialize(star.groupBy("k", "c").applyInPandas(run, link), "verified")
    large = dealt.where("chunks > 1")
    if large.isEmpty():
        return links
    roots = connected_components(links).withColumnRenamed("node", "v")
    labels = large.select("comp", "v").join(roots, "v", "left").select("comp", "v", F.coalesce("root", "v").alias("label"))
    labels = materialize(labels, "labels")
    main = labels.groupBy("comp", "label").count().groupBy("comp").agg(F.max(F.struct("count", "label")).alias("m"), F.sum("count").alias("n"))
    main = main.where("n > m.count").select("comp", F.col("m.label").alias("main"), F.ceil((F.col("n") - F.col("m.count")) / VERIFIED).cast("int").alias("blocks"))
    main = materialize(main, "main")
    if main.isEmpty():
        return links
    whole = large.join(labels.join(main, "comp").drop("comp"), "v")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ("comp", "v", "sig", "text", "label")
    met = whole.select(*kept, every("blocks").alias("x"), F.col("c").alias("y"), F.lit(False).alias("rest"))
    asked = whole.where("label <> main").select(*kept, F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("x"), every("chunks").alias("y"), F.lit(True).alias("rest"))
    return links.union(met.union(asked).groupBy("comp", "x", "y").applyInPandas(run, link))


def _grouped(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(doc_id, key, grp, component_id) of each row."""

    @F.pandas_udf("sig binary, digest binary")
    def sign(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, shingle) for t in texts]
        return pd.DataFrame({"sig": [signature(x) for x in sets], "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]})

    signed = docs.select(docs["doc_id"].alias("doc_id"), row_key(docs).alias("key"), F.xxhash64(docs["text"]).alias("h"), sign(docs["text"]).alias("s"))
    signed = materialize(signed.select("doc_id", "key", "h", "s.sig", "s.digest"), "signed")
    distinct = signed.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min("sig").alias("sig"), F.min("h").alias("h"))
    distinct = materialize(distinct.withColumn("v", F.monotonically_increasing_id()), "signatures")
    near = connected_components(similar_signatures(distinct.select("v", "sig"), similarity))
    members = near.select(F.col("node").alias("v"), F.col("root").alias("comp"))
    members = members.union(near.select(F.col("root").alias("v"), F.col("root").alias("comp")).distinct())
    members = materialize(members.join(distinct.select("v", "sig", "h"), "v"), "candidates")
    texts = docs.select(F.xxhash64(docs["text"]).alias("h"), docs["text"].alias("text"))
    roots = connected_components(verified_links(members, texts, shingle, similarity))
    rooted = distinct.join(roots.withColumnRenamed("node", "v"), "v", "left").select("digest", "least", F.coalesce("root", "v").alias("grp"))
    # Written, so that the join's sides are shuffled for it alone and a large component can be split.
    groups = materialize(rooted.groupBy("grp").agg(F.min("least").alias("component_id")), "groups")
    return signed.drop("sig", "h").join(rooted.join(groups, "grp").select("digest", "grp", "component_id"), "digest").drop("digest")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, component_id)``, a row for each row of ``docs(doc_id, text)``.

    component_id is the least doc_id of the documents reachable over links of that
    similarity or more, itself included. Null text counts as empty; texts without words are alike.
    Null doc_ids take part; a component of nothing else has component_id null. Repeated rows
    count each. An empty table gives none.
    """
    return _grouped(docs, shingle, similarity).select("doc_id", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each component: of the least doc_id, nulls last. Columns as they are."""
    return keep_chosen(docs, first_rows(_grouped(docs, shingle, similarity)))
