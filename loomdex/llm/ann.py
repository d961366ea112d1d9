"""Approximate nearest neighbours by cross-polytope hashing.

Vectors are rotated by three rounds of random signs and a Hadamard transform, and
fall to the nearest signed axis. Each of TABLES tables holds every vector in one
bucket; a query looks into the buckets of the axes that are nearest to it (multiprobe),
and everything it meets is ranked by exact inner products.

Largest inner products become smallest angles by one more coordinate,
sqrt(M^2 - |x|^2), where lengths differ. Equal vectors are hashed and compared once.
A bucket with many vectors or many queries is dealt into salted parts, all of which
are searched: nothing is capped. Queries that meet fewer than k vectors look into every
bucket of one table.

How many hash functions name a bucket and how many buckets a query looks into follow one rule at every size: of a bounded
sample of PILOT queries, the true neighbours are found by a scan, and with them the number of probes at which each is met. The most
functions, so that a bucket holds about BUCKET vectors or more, and the fewest probes are taken that find a share of AIM of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.runtime import materialize

#: Tables; sampled queries and the share of their neighbours that probes are to find; vectors of a bucket, at least about; probes of a
#: table at most, where there are several functions: with one, all buckets may be looked into.
TABLES, PILOT, AIM, BUCKET, MOST_PROBES = 8, 100, 0.96, 256, 1024
#: Vectors and queries of a part of a bucket.
PART_VECTORS, PART_QUERIES = 4096, 1024
SEED = 20_240_229


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, -1, 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2).reshape(n, width)
        step *= 2
    return x / np.sqrt(width)


def rotated(x: np.ndarray, table: int, function: int) -> np.ndarray:
    """A pseudo-random rotation of each row, the same on every executor."""
    width = 1 << max(1, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([SEED, table, function, width]).choice([-1.0, 1.0], (3, width))
    for s in signs:
        x = hadamard(x * s)
    return x


def buckets(x: np.ndarray, table: int, functions: int) -> np.ndarray:
    """The bucket of each row: its nearest signed axis under each function."""
    out = np.zeros(len(x), np.int64)
    for f in range(functions):
        r = rotated(x, table, f)
        axis = np.abs(r).argmax(axis=1)
        out = out * (2 * r.shape[1]) + 2 * axis + (r[np.arange(len(r)), axis] > 0)
    return out


def probes(x: np.ndarray, table: int, functions: int, count: int) -> np.ndarray:
    """The ``count`` buckets nearest to each row, nearest first."""
    code, loss = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
    for f in range(functions):
        r = rotated(x, table, f)
        signed = np.stack([-r, r], axis=2).reshape(len(r), -1)
        order = np.argsort(-signed, axis=1, kind="stable")[:, : min(count, signed.shape[1])]
        far = (signed.max(axis=1, keepdims=True) - np.take_along_axis(signed, order, axis=1)) ** 2
        code = (code[:, :, None] * signed.shape[1] + order[:, None, :]).reshape(len(x), -1)
        loss = (loss[:, :, None] + far[:, None, :]).reshape(len(x), -1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :count]
        code, loss = np.take_along_axis(code, best, axis=1), np.take_along_axis(loss, best, axis=1)
    return code


def _directions(vectors: np.ndarray, longest: float | None, query: bool) -> np.ndarray:
    """Unit vectors whose angles order inner products; ``longest`` is None where all lengths are alike."""
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    if longest is None:
        return vectors / lengths
    if query:
        return np.hstack([vectors / lengths, np.zeros_like(lengths)])
    scaled = vectors / longest
    return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])


def _by_width(rows: pd.DataFrame, kind: str) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    widths = rows["v"].map(len)
    for width in sorted(widths.unique()):
        part = rows[widths == width]
        yield part, np.frombuffer(b"".join(part["v"]), kind).reshape(len(part), -1).astype(np.float64)


def functions_for(n: int, width: int) -> int:
    """The most hash functions of a table that are tried for n vectors: buckets hold BUCKET or more on average."""
    return max(1, int(np.log(max(1.0, n / BUCKET)) / np.log(2 * width)))


def fitted(items: DataFrame, asked: DataFrame, longest: float | None, k: int, kind: str, n: int) -> tuple[int, int, int]:
    """(tables, functions, probes) for ``items(item, embedding)``, by the true neighbours of PILOT of the ``asked`` items."""
    sample = asked.orderBy(F.xxhash64("embedding"), "embedding").limit(PILOT).select("item", "embedding").collect()
    if not sample:
        return TABLES, 1, 1
    by_width: dict[int, list] = {}
    for r in sample:
        by_width.setdefault(len(r["embedding"]), []).append(r)
    most = functions_for(n, 1 << max(1, (max(by_width) - 1 + (longest is not None)).bit_length()))
    schema = "q long, score double, " + ", ".join(f"need{f} int" for f in range(1, most + 1))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lists: dict[tuple, np.ndarray] = {}
        for batch in batches:
            out = []
            for width, part in batch.groupby(batch["embedding"].map(len)):
                if width not in by_width:
                    continue
                raw = np.stack([np.asarray(v, kind) for v in part["embedding"]]).astype(np.float64)
                q = np.stack([np.asarray(r["embedding"], kind) for r in by_width[width]]).astype(np.float64)
                scores = q @ raw.T
                scores[np.array([r["item"] for r in by_width[width]])[:, None] == part["item"].to_numpy()] = -np.inf
                near = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                cells, where = np.unique(near, return_inverse=True)
                where, stored, asks = where.reshape(near.shape), _directions(raw[cells], longest, False), _directions(q, longest, True)
                needs = []
                for f in range(1, most + 1):
                    need = np.full(near.shape, np.iinfo(np.int32).max)
                    for t in range(TABLES):
                        key = (width, f, t)
                        if key not in lists:
                            lists[key] = probes(asks, t, f, MOST_PROBES if f > 1 else 1 << 30)
                        met = lists[key][:, None, :] == buckets(stored, t, f)[where][:, :, None]
                        need = np.minimum(need, np.where(met.any(axis=2), met.argmax(axis=2) + 1, np.iinfo(np.int32).max))
                    needs.append(need.ravel())
                best = np.take_along_axis(scores, near, axis=1)
                of = np.repeat([r["item"] for r in by_width[width]], near.shape[1])
                frame = pd.DataFrame({"q": of, "score": best.ravel(), **{f"need{f + 1}": x.astype(np.int32) for f, x in enumerate(needs)}})
                out.append(frame[np.isfinite(frame["score"])])
            if out:
                yield pd.concat(out)

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    found = items.select("item", "embedding").mapInPandas(scan, schema).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    true = found.toPandas()  # PILOT * k rows at most
    for f in range(most, 0, -1):
        needs = np.sort(true[f"need{f}"].to_numpy()) if len(true) else np.array([1])
        need = int(needs[min(len(needs) - 1, int(np.ceil(AIM * len(needs))) - 1)])
        if f == 1 or need <= MOST_PROBES:
            return TABLES, f, need
    raise AssertionError


def _nearest(k: int, kind: str):
    """Top k vectors of a part of a bucket for each of its queries, by exact products."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        asked, stored = rows[rows["asks"]], rows[~rows["asks"]]
        if len(asked) and len(stored):
            x = np.frombuffer(b"".join(stored["v"]), kind).reshape(len(stored), -1).astype(np.float64)
            q = np.frombuffer(b"".join(asked["v"]), kind).reshape(len(asked), -1).astype(np.float64)
            items, least = stored["item"].to_numpy(), stored["least"].to_numpy()
            rough = q @ x.T
            keep = min(k, len(items))
            cut = np.partition(rough, len(items) - keep, axis=1)[:, len(items) - keep] - 1e-9 * (1 + np.abs(rough).max())
            for i, item in enumerate(asked["item"]):
                near = np.flatnonzero(rough[i] >= cut[i])
                # Summed row by row in one order, so that equal vectors score alike anywhere.
                exact = (q[i] * x[near]).sum(axis=1)
                order = np.lexsort((least[near], -exact))[:keep]
                out.append((item, items[near[order]], exact[order]))
        return pd.DataFrame(out, columns=["q", "items", "scores"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k rows of ``vectors`` nearest to each row of ``queries`` that the index finds.

    Both have ``vec_id`` and ``embedding``, queries being rows of vectors. Nearest is the largest inner product in
    double precision, ties go to the smaller vec_id; a query's own vec_id is no candidate. Rows
    whose vec_id or vector is null, or whose vector is empty, zero, or holds null or non-finite
    components, take no part; vectors meet only those of their own width. Rows that repeat are candidates each; all rows of the
    query's vec_id are its own, and queries of one vec_id ask together, a candidate's score being its best one. Other columns are
    left out, whatever their names. A query has fewer than k rows only if there are fewer candidates. ``plan`` is (tables, hash functions a
    table, probes a table), by default fitted to the vectors.
    """
    element = vectors.schema["embedding"].dataType.elementType.typeName()
    kind = "f4" if element == "float" else "f8"  # as exact as the input
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    sound = F.coalesce(finite & F.exists(x, lambda e: e != 0), F.lit(False)) & F.col("vec_id").isNotNull()

    def valid(df: DataFrame) -> DataFrame:
        return df.select(df["vec_id"].cast("long").alias("vec_id"), df["embedding"].cast("array<float>" if kind == "f4" else "array<double>").alias("embedding")).where(sound)

    # Of equal vectors, no answer needs more than the k + 1 smallest vec_ids, each k times at most.
    rows = valid(vectors).groupBy("embedding", "vec_id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("m"))
    by_id = Window.partitionBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = rows.withColumn("n", F.row_number().over(by_id)).where(F.col("n") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_list(F.struct("vec_id", "m"))), 1, k + 1).alias("ids")
    items = few.groupBy("embedding").agg(ids).withColumn("item", F.monotonically_increasing_id())
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    items = materialize(items.withColumn("length", length), "items")
    stats = items.agg(F.count("*").alias("n"), F.max("length").alias("most"), F.min("length").alias("least")).first()
    longest = None if stats["n"] == 0 or stats["most"] - stats["least"] <= 1e-5 * stats["most"] else stats["most"]
    # Vectors of one vec_id, at most: so many of the nearest may be the query's own.
    own_most = items.select(F.explode("ids.vec_id").alias("vec_id")).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0
    most = k + own_most

    asking = materialize(
        valid(queries).distinct().join(items.select("embedding", "item"), "embedding").select(F.col("vec_id").alias("query_id"), "item"), "asking"
    )
    tables, functions, count = plan or fitted(items, items.join(asking.select("item").distinct(), "item", "left_semi"), longest, k, kind, stats["n"])
    packed = items.select("item", F.col("ids")[0]["vec_id"].alias("least"), F.col("embedding").alias("v"))
    asked_items = packed.join(asking.select("item").distinct(), "item", "left_semi")
    schema = "t int, bucket long, w int, item long, least long, v binary"

    def hashed(role: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                batch = batch.assign(v=[np.asarray(v, kind).tobytes() for v in batch["v"]])
                for part, raw in _by_width(batch, kind):
                    unit = _directions(raw, longest, role == "asked")
                    for t in range(tables):
                        if role == "stored":
                            code, owner = buckets(unit, t, functions), np.arange(len(part))
                        else:
                            code = probes(unit, t, functions, count)
                            owner = np.repeat(np.arange(len(part)), code.shape[1])
                        found = part.iloc[owner][["item", "least", "v"]]
                        yield found.assign(t=t, bucket=code.ravel(), w=raw.shape[1])[["t", "bucket", "w", "item", "least", "v"]]

        return run

    stored = packed.mapInPandas(hashed("stored"), schema)
    of_bucket = ["t", "bucket", "w"]
    held = materialize(stored.groupBy(of_bucket).agg(F.ceil(F.count("*") / PART_VECTORS).cast("int").alias("vs")), "held")

    def packs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(w=[len(v) for v in rows["v"]], v=[np.asarray(v, kind).tobytes() for v in rows["v"]])

    def met(asked: DataFrame, stored: DataFrame) -> DataFrame:
        load = materialize(asked.groupBy(of_bucket).agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("qs")).join(held, of_bucket), "load")
        deal = F.xxhash64("item")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        mine = lambda n: F.pmod(deal, F.col(n)).cast("int")
        a = stored.join(load, of_bucket).withColumn("vp", mine("vs")).withColumn("qp", every("qs"))
        b = asked.join(load, of_bucket).withColumn("qp", mine("qs")).withColumn("vp", every("vs"))
        both = a.withColumn("asks", F.lit(False)).unionByName(b.withColumn("asks", F.lit(True))).drop("vs", "qs")
        found = both.groupBy(*of_bucket, "vp", "qp").applyInPandas(_nearest(most, kind), "q long, items array<long>, scores array<double>")
        pairs = found.select("q", F.explode(F.arrays_zip("items", "scores")).alias("p")).select("q", "p.items", "p.scores").distinct()
        named = pairs.join(items.select(F.col("item").alias("items"), "ids"), "items")
        each = named.select("q", F.col("scores").alias("score"), "items", F.explode("ids").alias("i")).select("q", "score", "items", "i.*")
        best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "items")
        top = each.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
        return materialize(top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score", "items", "m"))).alias("top")), "top")

    found = met(asked_items.mapInPandas(hashed("asked"), schema), stored)
    weak = packed.join(found.where(F.size("top") >= most), packed["item"] == F.col("q"), "left_anti")
    weak = materialize(weak.join(asking.select("item").distinct(), "item", "left_semi"), "weak")
    if not weak.isEmpty():
        # Every bucket of one table: all vectors of the query's width.
        everywhere = held.where("t = 0").select("t", "bucket", "w")
        as_bytes = weak.mapInPandas(packs, "item long, least long, v binary, w int")
        again = met(as_bytes.join(everywhere, "w").select("t", "bucket", "w", "item", "least", "v"), stored.where("t = 0"))
        found = found.join(again.select("q"), "q", "left_anti").unionByName(again)
    own = asking.join(found.withColumnRenamed("q", "item"), "item").select("query_id", F.explode("top").alias("p")).select("query_id", "p.*")
    other = own.where("vec_id <> query_id").groupBy("query_id", "vec_id", "items").agg(F.max("score").alias("score"), F.max("m").alias("m"))
    other = other.withColumn("m", F.explode(F.sequence(F.lit(1), F.col("m"))))
    line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return other.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

