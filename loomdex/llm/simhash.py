"""SimHash near-duplicates by multi-index hashing.

Every text gets a 64-bit SimHash over word shingles. Distinct fingerprints are
cut into m segments. By the pigeonhole principle, two fingerprints that differ
in at most r bits agree within floor(r/m) bits in one of the first r mod m + 1
segments, or within one bit less in one of the others. So each fingerprint
is stored once per segment, looks up the Hamming ball of that radius around each
of its segments, and complete distances are verified on what it meets. m follows
the rule ceil(64 / log2 n) for n distinct fingerprints, so that a lookup meets
about one random fingerprint at any n; every m gives the same links.

Dense groups: fingerprints that share three of four 16-bit quarters first
take the least such fingerprint within r bits as their centre. Pairs with one
centre are connected already and aren't emitted.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.components import connected_components
from loomdex.llm.rows import first_of, keep_chosen, row_key
from loomdex.runtime import materialize

#: Shingles whose bits are unpacked at once: bounds memory on very long texts.
BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text; 0 for a text without words or null.

    A-Z is lower-cased; a bit is 1 if it is set in over half the shingles' XXH64.
    A text of fewer words than ``shingle`` has one shingle, its whole sequence.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = [
            digest(joined[a:b], seed)
            for a, b in zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        ]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 4) -> Column:
    """The SimHash as a signed long with the same bits."""

    @F.pandas_udf("long")
    def simhash64(texts: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint(t, shingle) for t in texts), np.uint64, len(texts))
        return pd.Series(values.view(np.int64))

    return simhash64(text)


def segments_for(n: int) -> int:
    """Number of segments for n distinct fingerprints; at most 4, so that some lookup is a ball."""
    return min(4, max(2, math.ceil(64 / math.log2(max(n, 2)))))


def _plan(radius: int, m: int) -> list[tuple[int, int, int]]:
    """(offset, width, ball radius) of each segment."""
    per, rest = divmod(radius, m)
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(sum(widths[:i]), w, per if i <= rest else per - 1) for i, w in enumerate(widths)]


def _signed(x: int) -> int:
    x &= 2**64 - 1
    return x - 2**64 if x >> 63 else x


def _segment(fp: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, offset).bitwiseAND(F.lit((1 << width) - 1))


def _flipped(value: Column, flips: list[int]) -> Column:
    return F.transform(F.lit(flips).cast("array<bigint>"), lambda x: value.bitwiseXOR(x))


def similar_fingerprints(prints: DataFrame, radius: int = 4, segments: int | None = None) -> DataFrame:
    """Links ``(u, v)`` whose components are those of all pairs within ``radius`` bits.

    ``prints(fp long)`` holds distinct fingerprints.
    """
    m = segments or segments_for(prints.count())
    fp = F.col("fp")
    quarters = F.array(
        *[F.struct(F.lit(i).alias("t"), fp.bitwiseAND(F.lit(_signed(~(0xFFFF << 16 * i)))).alias("k")) for i in range(4)]
    )
    keyed = prints.select("fp", F.explode(quarters).alias("q")).select("fp", "q.t", "q.k")
    least = keyed.groupBy("t", "k").agg(F.min("fp").alias("m"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("m"))) <= radius
    centred = materialize(
        keyed.join(least, ["t", "k"]).groupBy("fp").agg(F.min(F.when(near, F.col("m"))).alias("c")), "centred"
    )

    plan = _plan(radius, m)
    cells, balls = [], []
    for t, (offset, width, ball) in enumerate(plan):
        if ball < 0:
            continue
        tag, segment = F.lit(t << 40), _segment(fp, offset, width)
        flips = [sum(1 << b for b in bits) for r in range(ball + 1) for bits in combinations(range(width), r)]
        cells.append(segment.bitwiseOR(tag))
        balls.append(_flipped(segment.bitwiseOR(tag), flips))
    stored = centred.select(F.explode(F.array(*cells)).alias("k"), fp.alias("v"), F.col("c").alias("cv"))
    asked = centred.select(F.explode(F.concat(*balls)).alias("k"), fp.alias("u"), F.col("c").alias("cu"))
    met = asked.join(stored, "k").where(
        (F.col("u") < F.col("v"))
        & (F.col("cu") != F.col("cv"))
        & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    )
    return met.select("u", "v").union(centred.select("fp", "c"))


def _grouped(docs: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(doc_id, key, fp, grp, component_id) of each row; grp is the component's least fingerprint."""
    prints = materialize(
        docs.select(docs["doc_id"].alias("doc_id"), row_key(docs).alias("key"), fingerprint_column(docs["text"], shingle).alias("fp")), "prints"
    )
    by_print = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "by_print")
    roots = connected_components(similar_fingerprints(by_print.select("fp"), radius))
    rooted = by_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("grp")
    )
    groups = rooted.groupBy("grp").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.join(groups, "grp").select("fp", "grp", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``(doc_id, fp long, component_id)``, a row for each row of ``docs(doc_id, text)``.

    component_id is the least doc_id of the documents reachable over links of at
    most ``radius`` differing bits, itself included. Null text counts as empty;
    texts without words have fingerprint 0 and are linked like any other. Null
    doc_ids take part; a component of nothing else has component_id null. Rows
    that repeat a doc_id count as one document each. An empty table gives none.
    """
    return _grouped(docs, shingle, radius).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with one document of each component: a row of the least doc_id, nulls last.

    Columns stay as they are, whatever their names. Other cases as in :func:`near_duplicates`.
    """
    return keep_chosen(docs, first_rows(_grouped(docs, shingle, radius)))


def first_rows(grouped: DataFrame) -> DataFrame:
    """``(doc_id, key, keep)`` of ``grouped(doc_id, key, grp, ...)``: the row of the least doc_id and key of each group is kept."""
    grouped = materialize(grouped.select("doc_id", "key", "grp"), "grouped")
    first = grouped.groupBy("grp").agg(F.min(first_of(F.col("doc_id"), F.col("key"))).alias("first"))
    same = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return materialize(grouped.join(first, "grp").select("doc_id", "key", same.alias("keep")), "decided")
