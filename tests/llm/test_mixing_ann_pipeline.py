"""Source mixing, nearest neighbours and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loomdex.llm import ann, mixing

SF = "/root/testdata/sf0.001"


def water_filling(sizes):
    """Targets by hand: share by weight, stop at three times, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not full:
            return target | share
        target |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full
        if not open_:
            return target


def test_mix(docs, rows, empty):
    found = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda r: (str(r.doc_id), r.h, r.copies)
    assert sorted(map(key, found)) == sorted(map(key, again))
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    expected = water_filling(sizes)
    of = {(str(r[0]), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))): r[3] for r in rows}
    assert len(found) == len(rows)
    taken = {}
    for r in found:
        source = of[str(r.doc_id), r.size]
        if str(r.doc_id) not in ("None", "141"):
            assert r.source_size == sizes[source] and r.target == pytest.approx(expected[source])
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[r.source_size] = taken.get(r.source_size, 0) + r.taken
    for s, size in sizes.items():
        if list(sizes.values()).count(size) == 1 and size:
            assert abs(taken[size] - expected[s]) <= max(60, 0.25 * size)
    assert mixing.mix(empty).count() == 0


def test_word_count_and_targets(spark):
    texts = [None, "", "  ", "a", " a b\tc\n", "x y z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.word_count(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 0, 1, 3, 2]
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 300}
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    expected = water_filling(sizes)
    assert {r.source: pytest.approx(r.target) for r in rows} == expected
    assert all(r.target == 0 for r in mixing.targets(spark.createDataFrame([("a", 0)], "source string, source_size long")).collect())


def test_cube_keeps_totals():
    rng = np.random.default_rng(4)
    size, pi = rng.integers(1, 500, 2000).astype(float), np.full(2000, 0.3)
    moved = mixing.flight(pi, size, rng)
    assert ((moved > 0) & (moved < 1)).sum() <= 2
    assert moved.sum() == pytest.approx(600) and (moved * size).sum() == pytest.approx((pi * size).sum())
    landed = mixing.land(moved, size)
    assert set(landed) <= {0.0, 1.0} and abs(landed.sum() - 600) <= 2
    equal = mixing.flight(np.full(10, 0.5), np.full(10, 7.0), rng)
    assert equal.sum() == pytest.approx(5)


def test_many_groups(spark, monkeypatch):
    """Sources dealt into many groups, over several levels, still meet their targets."""
    monkeypatch.setattr(mixing, "GROUP_ROWS", 20)
    data = [(i, "w " * (1 + i * 37 % 90), "hot" if i % 3 else f"s{i % 2}") for i in range(900)]
    found = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"))
    sums = found.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("n")).collect()
    assert len(sums) >= 2 and all(abs(r.n - r.t) <= 60 for r in sums)


def test_repeated_documents(docs):
    out = mixing.repeat_documents(docs)
    assert out.columns == docs.columns
    copies = {(str(r.doc_id), r.h): r.copies for r in mixing.mix(docs).groupBy("doc_id", "h").agg(F.sum("copies").alias("copies")).collect()}
    got = {(str(r.doc_id), r.h): r["count"] for r in out.groupBy("doc_id", F.xxhash64("text").alias("h")).count().collect()}
    assert got == {k: v for k, v in copies.items() if v}


def brute(vectors, query, own, k):
    scores = [(-(np.array(v, np.float32).astype(float) * np.array(query, np.float32).astype(float)).sum(), i) for i, v in vectors if i != own and len(v) == len(query)]
    return [(i, -s) for s, i in sorted(set(scores))][:k]


@pytest.mark.parametrize("scale", [False, True])
@pytest.mark.parametrize("plan", [None, (16, 1, 8), (20, 2, 200)])
def test_neighbours(spark, scale, plan):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.5, 2, (600, 1))
    x[50:80] = x[50]  # equal vectors: ties go to the smaller id
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 10, plan).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hit = total = 0
    for q in range(0, 600, 20):
        want, got = brute(data, data[q][1], q, 10), [found[q][r] for r in range(1, 11)]
        assert all(abs(s - dict(brute(data, data[q][1], q, 600))[i]) < 1e-9 for i, s in got)
        assert got == sorted(got, key=lambda p: (-p[1], p[0]))
        hit, total = hit + len({i for i, _ in want} & {i for i, _ in got}), total + 10
    assert hit / total >= 0.9
    assert [i for i, _ in [found[60][r] for r in range(1, 11)]] == list(range(50, 60))


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, []),
            (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (40, [1.0, 2.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    found = sorted(tuple(r) for r in ann.search(df, df.where("vec_id % 20 = 0"), 20).collect())
    # The row of vec_id 1 is there twice, and is a candidate twice.
    assert found == [(0, 1, 1, 0.5), (0, 2, 1, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 1, 0.5), (20, 3, 0, 0.0), (40, 1, 8, 11.0)]
    assert ann.search(df.limit(0), df.limit(0), 20).count() == 0


def test_double_vectors_stay_exact(spark):
    data = [(0, [0.1, 0.0]), (1, [0.3, 1.0]), (2, [0.2, 1.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = ann.search(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.1 * 0.3), (2, 0.1 * 0.2)]


def test_hot_bucket_parts(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_VECTORS", 7)
    monkeypatch.setattr(ann, "PART_QUERIES", 2)
    rng = np.random.default_rng(8)
    x = np.ones((200, 8)) + rng.normal(0, 0.01, (200, 8))
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    got = ann.search(df, df.where("vec_id % 20 = 0"), 5).collect()
    for q in range(0, 200, 20):
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [i for i, _ in brute(data, data[q][1], q, 5)]


def test_pipeline_stages(spark, tmp_path, docs, empty, labels):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece"]
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    for table in (docs, empty):
        now = table
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, now, folder)
            if i < 4:
                assert out.dtypes == now.dtypes
            path = f"{folder}/out-{'empty' if table is empty else 'full'}-{i}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
        assert "ids" in now.columns
    assert spark.read.parquet(f"{folder}/out-empty-4").count() == 0


def test_pipeline_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "n_pieces"] and out.count() > 50
    assert out.where("n_pieces <> size(ids)").count() == 0
