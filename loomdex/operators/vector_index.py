"""The vector table: upsert, delete, tenant-filtered cosine search."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.config import EngineConfig
from loomdex.functions.hashing import hash_of_vector_id, vector_id
from loomdex.functions.vectors import is_zero
from loomdex.operators.upsert import latest_by_key
from loomdex.runtime import BROADCAST_LIMIT_BYTES, ship


def to_rows(chunks: DataFrame, full_ids: bool = True) -> DataFrame:
    """Rows of the index from ``chunks`` with ``embedding``: zero vectors go, a null name is stored as ''."""
    id_ = vector_id(F.col("user_id"), F.col("project_id"), F.col("hash"), full_ids)
    return chunks.where(F.col("embedding").isNotNull() & ~is_zero(F.col("embedding"))).withColumn("id", id_).withColumn("name", F.coalesce("name", F.lit("")))


def from_rows(rows: DataFrame) -> DataFrame:
    """What a search returns of rows: '' is no name."""
    return rows.withColumn("name", F.nullif(F.col("name"), F.lit("")))


def upsert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The index after ``rows``; both have ``id``, ``version`` and ``seq``, and of one id the last stays."""
    return latest_by_key(index.unionByName(rows), ["id"], ["version", "seq"])


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id").distinct(), "id", "left_anti")


#: Queries and rows, about, that meet in one task.
QUERY_BLOCK, ROW_BLOCK = 20_000, 20_000
#: Queries and rows of one matrix of cosines, and pairs that are scored or wait to be sorted at a time: what a worker holds doesn't depend on the tables' sizes.
QUERY_TILE, ROW_TILE, PAIRS, PENDING = 512, 4096, 1 << 16, 1 << 20
#: Rows that a worker sends back at once.
SENT = 10_000
#: Decimals of a score that count in ranking, since sums in another order differ beyond them, and that are returned.
RANKED, SHOWN = 12, 6

_FOUND = pa.schema([("query_id", pa.string()), ("id", pa.string()), ("score", pa.float64()), ("mine", pa.bool_())])


def _matrices(vec: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width."""
    sizes, out = pc.list_value_length(vec).to_numpy(zero_copy_only=False), {}
    for width in set(sizes.tolist()) - {0}:
        at = np.flatnonzero(sizes == width)
        out[width] = at, vec.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, width)
    return out


def _lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


class _Best:
    """The ``most`` best rows of each of ``asked(query_id, key, vec)``, of blocks of ``rows(id, key, vec)`` as they come."""

    def __init__(self, asked: pa.Table, most: int, exact: bool):
        asked = asked.combine_chunks()
        self.names, self.most, self.exact = _whole(asked["query_id"]), most, exact
        keys = asked["key"].to_pylist()
        self.code = {k: i for i, k in enumerate(dict.fromkeys(k for k in keys if k is not None))}
        self.keys = np.array([self.code.get(k, -2) for k in keys], np.int64)  # null keys have no rows of their own
        self.vectors = {w: (at, v, _lengths(v)) for w, (at, v) in _matrices(_whole(asked["vec"])).items()}
        self.bar = np.full(len(keys), -np.inf)
        self.q, self.score, self.mine = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool)
        self.ids, self.waiting, self.n_waiting = pa.array([], pa.string()), [], 0

    def add(self, rows: pa.RecordBatch | pa.Table) -> None:
        if not rows.num_rows:
            return
        rows = rows.take(pc.sort_indices(rows["id"]))
        known, ids = _whole(rows["key"]).dictionary_encode(), _whole(rows["id"])
        codes = np.array([self.code.get(k, -1) for k in known.dictionary.to_pylist()] + [-1], np.int64)
        keys = codes[known.indices.fill_null(len(codes) - 1).to_numpy(zero_copy_only=False)]
        for width, (at, x) in _matrices(_whole(rows["vec"])).items():
            if width not in self.vectors:
                continue
            asked = self.vectors[width]
            for code in set(keys[at].tolist()) - {-1} if self.exact else [None]:
                r = np.arange(len(at)) if code is None else np.flatnonzero(keys[at] == code)
                a = np.arange(len(asked[0])) if code is None else np.flatnonzero(self.keys[asked[0]] == code)
                self._meet(asked, a, at, x, _firsts(x, r, self.most), keys, ids)
        self._cut(ids)

    def _meet(self, asked, a: np.ndarray, at: np.ndarray, x: np.ndarray, r: np.ndarray, keys: np.ndarray, ids: pa.Array) -> None:
        for i in range(0, len(r), ROW_TILE):
            tile = r[i : i + ROW_TILE]
            e = x[tile]
            lengths = _lengths(e)
            for j in range(0, len(a), QUERY_TILE):
                some = a[j : j + QUERY_TILE]
                q, v, asked_lengths = asked[0][some], asked[1][some], asked[2][some]
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    rough = (v @ e.T) / (asked_lengths[:, None] * lengths)
                keep = np.isfinite(rough) & (rough >= self.bar[q][:, None])
                full = np.flatnonzero(keep.sum(axis=1) > self.most)
                if len(full):
                    some = np.where(keep[full], rough[full], -np.inf)
                    keep[full] &= rough[full] >= np.partition(some, len(tile) - self.most, axis=1)[:, len(tile) - self.most, None] - 1e-9
                n, m = np.nonzero(keep)
                for k in range(0, len(n), PAIRS):
                    f, g = n[k : k + PAIRS], m[k : k + PAIRS]
                    # Summed row by row in one order, so that equal vectors score alike anywhere.
                    s = np.round((e[g] * v[f]).sum(axis=1) / (lengths[g] * asked_lengths[f]), RANKED) + 0.0
                    self.waiting.append((q[f], s, at[tile[g]], keys[at[tile[g]]] == self.keys[q[f]]))
                    self.n_waiting += len(f)
                    if self.n_waiting > PENDING:
                        self._cut(ids)

    def _cut(self, ids: pa.Array) -> None:
        """Only the best of each query stay; ties go to the smaller id."""
        if not self.waiting:
            return
        q, s, r, mine = (np.concatenate(c) for c in zip(*self.waiting, strict=True))
        self.waiting, self.n_waiting = [], 0
        q, s, mine = np.concatenate([self.q, q]), np.concatenate([self.score, s]), np.concatenate([self.mine, mine])
        every = pa.concat_arrays([self.ids, ids.take(pa.array(r))])
        by = [("q", "ascending"), ("s", "descending"), ("id", "ascending")]
        order = pc.sort_indices(pa.table({"q": q, "s": s, "id": every}), sort_keys=by).to_numpy()
        first = np.searchsorted(q[order], q[order])
        order = order[np.arange(len(order)) - first < self.most]
        self.q, self.score, self.mine, self.ids = q[order], s[order], mine[order], every.take(pa.array(order))
        last = np.flatnonzero(np.bincount(self.q, minlength=len(self.bar)) == self.most)
        self.bar[last] = self.score[np.searchsorted(self.q, last, "right") - 1] - 1e-9

    def found(self) -> pa.Table:
        return pa.table([self.names.take(pa.array(self.q)), self.ids, pa.array(self.score), pa.array(self.mine)], schema=_FOUND)


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.Array):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _firsts(x: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """``rows`` but for copies of vectors that ``most`` rows before them have: they score alike, and smaller ids go first."""
    if len(rows) <= most:
        return rows
    same = np.ascontiguousarray(x[rows]).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
    _, group = np.unique(same, return_inverse=True)
    order = np.argsort(group, kind="stable")
    nth = np.arange(len(order)) - np.searchsorted(group[order], group[order])
    return rows[np.sort(order[nth < most])]


def search_all(index: DataFrame, queries: DataFrame, k: int | None = None, config: EngineConfig = EngineConfig(), tenant: tuple[str, ...] = ("user_id", "project_id")) -> DataFrame:
    """``(query_id, rank, id, score)`` of any number of ``queries(query_id, vector, <tenant columns>)``.

    In ``exact`` mode rows of other tenants are filtered before ranking; in ``faithful`` mode the min(3k, 20) best of all
    tenants are taken first, so that fewer than k may be left. Cosines are ranked at 12 decimals, ties going to the smaller id,
    and returned to 6. A zero vector has no result and is none; a null tenant has none.

    Queries whose size was checked are sent to all tasks, and the index is scanned once; of more, blocks meet blocks of all rows.
    """
    ship(index.sparkSession)
    k = config.top_k if k is None else k
    exact = config.search_mode == "exact"
    most = k if exact else min(config.over_fetch * k, config.top_k_cap)
    whole = reduce(lambda a, b: a & b, [F.col(t).isNotNull() for t in tenant])
    key = F.when(whole, F.to_json(F.struct(*[F.col(t).cast("string").alias(t) for t in tenant]))).alias("key")
    kind, sound = dict(queries.dtypes)["query_id"], "vec is not null and not exists(vec, v -> v is null)"
    vec = lambda c: F.col(c).cast("array<double>").alias("vec")
    asked = queries.select(F.col("query_id").cast("string").alias("query_id"), key, vec("vector")).where(sound)
    rows = index.select("id", key, vec("embedding")).where(sound)
    schema = "query_id string, id string, score double, mine boolean"
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first()
    if 64 * size["n"] + 8 * size["numbers"] <= BROADCAST_LIMIT_BYTES:
        sent = index.sparkSession.sparkContext.broadcast(asked.toArrow())

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = _Best(sent.value, most, exact)
            for batch in batches:
                best.add(batch)
            yield from best.found().to_batches(SENT)

        best = rows.mapInArrow(scan, schema)
    else:
        n_queries, n_rows = max(1, math.ceil(size["n"] / QUERY_BLOCK)), max(1, math.ceil(index.count() / ROW_BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        a = asked.select("query_id", F.lit(None).cast("string").alias("id"), "key", "vec", block("query_id", n_queries).alias("x"), every(n_rows).alias("y"))
        b = rows.select(F.lit(None).cast("string").alias("query_id"), "id", "key", "vec", every(n_queries).alias("x"), block("id", n_rows).alias("y"))

        def meet(both: pa.Table) -> pa.Table:
            of = pc.is_null(both["id"])
            best = _Best(both.filter(of), most, exact)
            best.add(both.filter(pc.invert(of)).combine_chunks())
            return best.found()

        best = a.union(b).groupBy("x", "y").applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    best = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).where("mine")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select(F.col("query_id").cast(kind).alias("query_id"), "rank", "id", F.round("score", SHOWN).alias("score"))


def search(index: DataFrame, queries: list[dict], k: int | None = None, config: EngineConfig = EngineConfig(), tenant: tuple[str, ...] = ("user_id", "project_id")) -> DataFrame:
    """As :func:`search_all`, for a list of queries ``{query_id, vector, <tenant columns>}``."""
    kinds = {"query_id": "long" if all(isinstance(q["query_id"], int) for q in queries) else "string", **{t: dict(index.dtypes)[t] for t in tenant}}
    name = int if kinds["query_id"] == "long" else str
    rows = [(name(q["query_id"]), [float(v) for v in q["vector"]], *[q[t] for t in tenant]) for q in queries]
    schema = f"query_id {kinds['query_id']}, vector array<double>, " + ", ".join(f"{t} {kinds[t]}" for t in tenant)
    return search_all(index, index.sparkSession.createDataFrame(rows, schema), k, config, tenant)


#: What a search tells of a chunk besides its place and score, where the index has it.
DETAILS = ("hash", "summary", "type", "name", "language_id", "line_start", "line_end", "relative_path")


def with_details(found: DataFrame, index: DataFrame) -> DataFrame:
    """``found(query_id, rank, id, score)`` with what the index knows of each chunk: summary, type, name, language, lines and file.

    The hash is the index's, else the part of the id that stands for it; '' is no name.
    """
    known = from_rows(index) if "name" in index.columns else index
    told = found.join(known.select("id", *[c for c in DETAILS if c in index.columns]), "id")
    return told if "hash" in told.columns else told.withColumn("hash", hash_of_vector_id(F.col("id")))
