"""Mixing sources to target weights by balanced sampling with the cube method.

A source that is to give r times its size gives each document floor(r) times,
and once more with probability r - floor(r). The cube method makes these draws
so that the source's totals of documents and of words stay what the probabilities
promise: it moves the probabilities of three documents at a time within the null
space of both constraints until one of them is decided. Large sources are dealt
into salted groups, each of which leaves at most two undecided documents; these
are dealt again until each source is one group, whose last few documents are
landed so as to change the totals least.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.llm.rows import row_key, text_key
from loomdex.operators.ranking import with_positions
from loomdex.runtime import materialize

#: Weights of the sources by code point, repeating; most times that a source is taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents of a source that one task balances at once.
GROUP_ROWS = 4_000
#: Documents of a source that wait for the landing, besides those that flight leaves undecided.
HELD = 12

WHITESPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, WHITESPACE))).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes(source, source_size)`` with ``target``: a source's share of all sizes by weight.

    Sources are weighted in order of code points, null last. A target stops at MOST times its
    source's size; what is above is shared by weight again, until none is above. Only sums over
    the sources reach the driver.
    """
    placed = with_positions(sizes, [], [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighed = materialize(placed.withColumn("weight", weight.cast("double")).drop("place"), "weighed")
    top = F.col("source_size") * float(MOST)
    level = 0.0
    while True:
        under = top > F.col("weight") * level
        sums = weighed.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(~under, top)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(under, F.col("weight"))), F.lit(0.0)).alias("open"),
        ).first()
        after = (sums["all"] - sums["full"]) / sums["open"] if sums["open"] else level
        if after <= level:
            return weighed.withColumn("target", F.when(under, F.col("weight") * level).otherwise(top)).drop("weight")
        level = after


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Move probabilities to 0 or 1, all but at most two, keeping sum(pi) and sum(pi * size)."""
    pi, eps = pi.astype(float).copy(), 1e-9
    out = np.where(pi < eps, 0.0, np.where(pi > 1 - eps, 1.0, pi))
    queue = [i for i in range(len(out)) if 0.0 < out[i] < 1.0]
    draws = rng.random(len(queue) + 1).tolist()
    p, s = out.tolist(), size.tolist()
    held: list[int] = []
    for k, i in enumerate(queue):
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (s[c] - s[b], s[a] - s[c], s[b] - s[a])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for x, v in zip(held, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[x]) / v), min(down, p[x] / v)
            elif v < 0:
                up, down = min(up, -p[x] / v), min(down, (p[x] - 1) / v)
        step = up if draws[k] * (up + down) < down else -down
        for x, v in zip(held, u, strict=True):
            p[x] += step * v
        for x in held:
            p[x] = 0.0 if p[x] < eps else 1.0 if p[x] > 1 - eps else p[x]
        if all(0.0 < p[x] < 1.0 for x in held):  # rounding: decide the nearest
            x = min(held, key=lambda x: min(p[x], 1 - p[x]))
            p[x] = float(p[x] > 0.5)
        held = [x for x in held if 0.0 < p[x] < 1.0]
    return np.array(p)


def land(pi: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decide the few documents that are left, changing the totals of words, then of documents, least."""
    out = pi.copy()
    left = np.flatnonzero((pi > 0) & (pi < 1))
    take = (np.arange(1 << len(left))[:, None] >> np.arange(len(left)) & 1).astype(float)
    moved = take - pi[left]
    cost = np.abs(moved @ size[left]) / max(1.0, size.mean()) + 0.01 * np.abs(moved.sum(axis=1))
    out[left] = take[int(cost.argmin())]
    return out


def _balance(last: bool):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        # Long documents first, so that those left undecided are short.
        rows = rows.sort_values(["size", "no_id", "id", "h"], ascending=[False, True, True, True], kind="stable")
        first = rows.iloc[0]
        rng = np.random.default_rng(crc32(f"{first['source']}|{first['salt']}|{len(rows)}".encode("utf-8", "surrogatepass")))
        size = rows["size"].to_numpy(float)
        pi = rows["pi"].to_numpy(float)
        held = np.zeros(len(pi), bool)
        if last:  # documents of all sizes wait for the landing
            held[np.linspace(0, len(pi) - 1, min(HELD, len(pi))).astype(int)] = True
        pi[~held] = flight(pi[~held], size[~held], rng)
        if last:
            pi = land(pi, size)
        return rows.assign(pi=pi)

    return run


def _salts(rows: DataFrame) -> DataFrame:
    """Number of groups into which each source's undecided rows are dealt."""
    n = F.ceil(F.count("*") / GROUP_ROWS).cast("int")
    return rows.groupBy(F.col("source").alias("s")).agg(n.alias("salts"))


def mix(docs: DataFrame) -> DataFrame:
    """``(doc_id, h, size, source_size, target, copies, taken)``, a row for each row of ``docs``.

    size is the number of words, source_size that of the row's source, target the words that
    its source is to give, taken = copies * size. A source without words has target 0 and
    copies 0. Null is a source of its own, the last; null text has size 0. Rows that repeat
    are drawn each for itself. Draws depend on the rows alone: reruns agree.
    """
    sized = materialize(
        # Without nulls, pandas keeps long integers exact.
        docs.select(
            F.coalesce(docs["doc_id"], F.lit(0)).alias("id"),
            docs["doc_id"].isNull().alias("no_id"),
            text_key().alias("h"),
            docs["source"].alias("source"),
            word_count(docs["text"]).alias("size"),
        ),
        "sized",
    )
    aims = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    aims = materialize(aims.withColumnRenamed("source", "s"), "aims")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    drawn = sized.join(aims, sized["source"].eqNullSafe(aims["s"])).drop("s").withColumn("rate", F.least(rate, F.lit(float(MOST))))
    drawn = drawn.withColumn("base", F.floor("rate").cast("int")).withColumn("pi", F.col("rate") - F.col("base")).drop("rate")

    done, level = [drawn.where("pi = 0").withColumn("salt", F.lit(0))], 0
    open_rows = drawn.where("pi > 0")
    while True:
        salts = materialize(_salts(open_rows), "salts")
        most = salts.agg(F.max("salts")).first()[0]
        if most is None:
            break
        salted = open_rows.drop("salt").join(salts, open_rows["source"].eqNullSafe(salts["s"])).drop("s")
        deal = F.pmod(F.xxhash64("id", "h", F.lit(level)), F.col("salts")).cast("int")
        salted = salted.withColumn("salt", F.when(F.lit(most == 1), 0).otherwise(deal)).drop("salts")
        moved = salted.groupBy("source", "salt").applyInPandas(_balance(last=most == 1), salted.schema)
        moved = materialize(moved, f"level{level}")
        if most == 1:
            done.append(moved)
            break
        done.append(moved.where("pi in (0, 1)"))
        open_rows, level = moved.where("pi not in (0, 1)"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    copies = F.col("base") + F.col("pi").cast("int")
    return out.select(
        F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "h", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def repeat_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns as they are.

    Rows equal in doc_id and text count as one, with the sum of their copies: that of the least hash of all columns.
    """
    drawn = mix(docs).groupBy("doc_id", "h").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("n"))
    drawn = materialize(drawn.where("copies > 0").select(F.col("doc_id").alias("d"), F.col("h").alias("k"), "copies", "n"), "drawn")
    columns = [docs[c] for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("r"), docs["doc_id"].alias("i"), F.xxhash64(docs["text"]).alias("h"), row_key(docs).alias("key"))
    met = rows.join(drawn, rows["i"].eqNullSafe(drawn["d"]) & (rows["h"] == drawn["k"]))
    once = met.where("n = 1").select("r", "copies")
    if not drawn.where("n > 1").isEmpty():
        several = met.where("n > 1").groupBy("i", "h").agg(F.min_by("r", "key").alias("r"), F.first("copies").alias("copies"))
        once = once.unionByName(several.select("r", "copies"))
    return once.select("r", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("r.*")
