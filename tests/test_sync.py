"""Golden cases of synchronisation, Merkle trees, search, requests and streams."""

import os
import subprocess
import sys
import time
from hashlib import sha256
from pathlib import Path

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from loomdex.config import ChunkConfig, EngineConfig
from loomdex.functions import hashing, requests
from loomdex.operators import cache, hash_only, merkle, models, sync, vector_index
from loomdex.operators.ranking import with_positions
from loomdex.sources import file_tree
from loomdex.operators.telemetry import Telemetry
from loomdex.operators.upsert import latest_by_key
from loomdex.streaming import log as log_module
from loomdex.streaming.dirty import DirtyFold, dirty_since_sync, drain, periodic_sync
from loomdex.streaming.dirty import watch as watch_stream
from loomdex.streaming.watch import MerkleWatch, first_creations

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
NOW = "2024-05-01 00:00:00"
CHUNK = "user_id string, project_id string, hash string, relative_path string, name string, language_id string, code string, seq int"
CONFIG = EngineConfig(dimensions=8)


def embedder(texts):
    return [[float(len(t) % 7 + 1), 1.0] + [0.0] * 6 for t in texts]


def chunks(spark, user, *hashes):
    rows = [(user, f"p-{user}", h, f"{user}/{h}.ts", None, "typescript", f"code of {h}", i) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, CHUNK)


@pytest.fixture
def empty(spark):
    known = spark.createDataFrame([], "hash string, summary string, embedding array<float>, expires_at timestamp")
    roots = spark.createDataFrame([], "user_id string, project_id string, root string")
    return sync.State(known, None, roots)


def run(state, rows, version, provider=embedder):
    return sync.process(rows, state, cache.literal_time(NOW), version, embedder=provider, config=CONFIG)


def counts(frame):
    return [(r.received, r.processed, r.hits, r.stored, r.status) for r in frame.collect()]


def test_cold_then_warm_across_tenants(spark, empty):
    state, first = run(empty, chunks(spark, "alice", "hash001", "hash002"), 1)
    assert counts(first) == [(2, 2, 0, 2, "indexed")]
    state, second = run(state, chunks(spark, "bob", "hash001", "hash002"), 2)
    assert counts(second) == [(2, 0, 2, 2, "indexed")]
    state, third = run(state, chunks(spark, "carol", "hash001"), 3)
    assert counts(third) == [(1, 0, 1, 1, "indexed")]
    assert {(r.user_id, r.relative_path) for r in state.vectors.where("hash = 'hash001'").collect()} == {(u, f"{u}/hash001.ts") for u in ("alice", "bob", "carol")}


def test_two_phases(spark, empty):
    state, _ = run(empty, chunks(spark, "alice", "hash001"), 1)
    both = chunks(spark, "alice", "hash001", "new", "new")
    assert [r.hash for r in cache.needed(both, state.cache).collect()] == ["new", "new"]
    told = sync.phase1(both, state.cache).first()
    assert (told.received, told.hits, told.needed, told.vectorized) == (3, 1, 2, 1)
    sent = cache.needed_chunks(both, cache.needed(both, state.cache))
    state, done = run(state, sent, 2)
    assert counts(done) == [(2, 2, 0, 1, "indexed")]
    assert state.cache.count() == 2 and state.vectors.count() == 2


def test_failures_are_not_stored(spark, empty):
    state, told = run(empty, chunks(spark, "alice", "a", "b"), 1, lambda texts: [[0.0] * 8 for _ in texts])
    assert counts(told) == [(2, 2, 0, 0, "partial")]
    assert state.cache.count() == 0 and state.vectors.count() == 0

    def broken(texts):
        raise RuntimeError("no model")

    assert counts(run(empty, chunks(spark, "alice", "a"), 1, broken)[1]) == [(1, 1, 0, 0, "partial")]
    assert counts(run(empty, chunks(spark, "alice", "a").limit(0), 1)[1]) == []


def test_providers():
    assert models.embed_query("x", lambda t: 1 / 0, 3) == [0.0, 0.0, 0.0]
    assert models.embed_query("x", embedder, 8)[1] == 1.0
    assert models.hashing_embedder(16)(["", "a b"])[0] == [0.0] * 16

    slow = models.with_timeout(lambda t: time.sleep(2) or embedder(t), 0.05)
    quick = EngineConfig(retry_pause=0.01, query_timeout=0.05)
    assert models.embed_query("x", slow, 8, config=quick) == models.embed_query("x", lambda t: time.sleep(2), 8, config=quick) == [0.0] * 8
    assert models.with_timeout(embedder, 5)(["x"]) == embedder(["x"])


def test_hash_only_mode(spark):
    def rows(*hashes):
        return spark.createDataFrame([("p", h) for h in hashes], "project_id string, hash string")

    now = cache.literal_time(NOW)
    known, told = hash_only.init(rows("h1"), spark.createDataFrame([], "hash string, expires_at timestamp"), now)
    assert [(r.stored, r.skipped) for r in told.collect()] == [(1, 0)]
    known, told = hash_only.phase1(rows("h1", "h2"), known, now)
    assert sorted((r.hash, r.state) for r in told.collect()) == [("h1", "cached"), ("h2", "needed")]
    known = hash_only.phase2(rows("h2"), known, now)
    assert sorted(r.hash for r in known.collect()) == ["h1", "h2"]
    assert [(r.stored, r.skipped) for r in hash_only.init(rows("h1", "h2", "h2"), known, now)[1].collect()] == [(0, 3)]


def test_expiry_and_put(spark):
    rows = [("a", "2024-05-01 00:00:00"), ("b", "2024-05-01 00:00:01")]
    known = spark.createDataFrame(rows, "hash string, e string").select("hash", F.to_timestamp("e").alias("expires_at"))
    assert [r.hash for r in cache.alive(known, cache.literal_time(NOW)).collect()] == ["b"]
    seen = cache.refresh(known, known, cache.literal_time(NOW), 30)
    assert {r.hash: str(r.expires_at) for r in seen.collect()} == {"a": "2024-05-01 00:00:00", "b": "2024-05-31 00:00:00"}
    stored = cache.put(known, spark.createDataFrame([("a",), ("c",)], "hash string"), cache.literal_time(NOW), 90)
    assert {r.hash: str(r.expires_at)[:10] for r in stored.collect()} == {"a": "2024-07-30", "b": "2024-05-01", "c": "2024-07-30"}


def test_whole_sync(spark, empty):
    def tree(**contents):
        rows = [("u", "p", path, text, "text") for path, text in contents.items()]
        return spark.createDataFrame(rows, "user_id string, project_id string, relative_path string, content string, language_id string")

    config = EngineConfig(chunks=ChunkConfig(min_chunk=3), dimensions=8)
    now = cache.literal_time(NOW)
    state, told = sync.sync(tree(a="first text", b="second text"), empty, now, 1, config)
    assert counts(told) == [(2, 2, 0, 2, "indexed")] and state.roots.count() == 1
    state, told = sync.sync(tree(a="first text", b="second text"), state, now, 2, config)
    assert counts(told) == []
    state, told = sync.sync(tree(a="first text", c="third text"), state, now, 3, config)
    assert counts(told) == [(2, 1, 1, 2, "indexed")]
    assert {r.relative_path for r in state.vectors.collect()} == {"a", "c"}


def owned(spark, *rows):
    return spark.createDataFrame([(*r, "text") for r in rows], "user_id string, project_id string, relative_path string, content string, language_id string")


def test_tenants_that_share_project_ids(spark, empty):
    """Two users with a project of one id: each has their own files, vectors and root."""
    config = EngineConfig(chunks=ChunkConfig(min_chunk=3), dimensions=8)
    files = owned(spark, ("alice", "p", "a", "text of alice"), ("bob", "p", "b", "text of bob"), ("bob", "q", "b", "more of bob"))
    state, told = sync.sync(files, empty, cache.literal_time(NOW), 1, config)
    assert {(r.user_id, r.project_id, r.relative_path) for r in state.vectors.collect()} == {("alice", "p", "a"), ("bob", "p", "b"), ("bob", "q", "b")}
    roots = {(r.user_id, r.project_id): r.root for r in state.roots.collect()}
    assert roots == {(u, p): sha256(f"{f}{c}".encode()).hexdigest() for u, p, f, c in (("alice", "p", "a", "text of alice"), ("bob", "p", "b", "text of bob"), ("bob", "q", "b", "more of bob"))}
    assert sorted((r.user_id, r.received) for r in told.collect()) == [("alice", 1), ("bob", 1), ("bob", 1)]
    # Only what one of them changes is worked on.
    files = owned(spark, ("alice", "p", "a", "text of alice"), ("bob", "p", "b", "other of bob"), ("bob", "q", "b", "more of bob"))
    state, told = sync.sync(files, state, cache.literal_time(NOW), 2, config)
    assert [(r.user_id, r.project_id, r.received) for r in told.collect()] == [("bob", "p", 1)]
    assert state.vectors.count() == 3


def test_dirty_files_only(spark, empty):
    """Files that aren't dirty aren't cut again; their vectors stay, also where a dirty file loses a chunk that they have."""
    config, now = EngineConfig(chunks=ChunkConfig(min_chunk=3), dimensions=8), cache.literal_time(NOW)
    state, _ = sync.sync(owned(spark, ("u", "p", "a", "same text"), ("u", "p", "b", "same text"), ("u", "p", "c", "third text")), empty, now, 1, config)
    dirty = spark.createDataFrame([("u", "p", "a"), ("u", "p", "gone")], "user_id string, project_id string, relative_path string")
    state, told = sync.sync(owned(spark, ("u", "p", "a", "new text"), ("u", "p", "b", "same text")), state, now, 2, config, dirty=dirty)
    assert counts(told) == [(1, 1, 0, 1, "indexed")]
    assert sorted((r.relative_path, r.hash == sha256(b"same text").hexdigest()) for r in state.chunks.collect()) == [("a", False), ("b", True)]
    assert {r.hash for r in state.vectors.collect()} == {sha256(t).hexdigest() for t in (b"same text", b"new text")}


def test_commit_modes_and_telemetry(spark, empty, monkeypatch):
    now, stored, files = cache.literal_time(NOW), [], owned(spark, ("u", "p", "a", "some text of it"))
    seen = Telemetry()
    sync.sync(files, empty, now, 1, EngineConfig(chunks=ChunkConfig(min_chunk=3), dimensions=8), store_roots=lambda r: stored.append(r.count()), telemetry=seen)
    assert stored == [1]
    assert [(r["span"], r.get("received"), r.get("processed"), r.get("vectors")) for r in seen.report()] == [("lookup", 1, None, None), ("models", None, 1, None), ("upsert", None, None, 1)]
    monkeypatch.setattr(sync, "process", lambda *a, **k: 1 / 0)
    for mode, written in (("first", 2), ("last", 2)):
        with pytest.raises(ZeroDivisionError):
            sync.sync(files, empty, now, 1, EngineConfig(commit_mode=mode), store_roots=lambda r: stored.append(r.count()))
        assert len(stored) == written


def test_syntax_chunks_are_synced(spark, empty):
    code = "import x from 'y';\n\nexport function alpha(a, b) {\n  return a + b;\n}\n\nclass Beta {\n  run() { return 1; }\n}\n"
    files = spark.createDataFrame([("u", "p", "m.js", code, "javascript"), ("u", "p", "n.txt", "plain text here", "text")], "user_id string, project_id string, relative_path string, content string, language_id string")
    state, _ = sync.sync(files, empty, cache.literal_time(NOW), 1, EngineConfig(chunks=ChunkConfig(min_chunk=5), dimensions=8))
    assert sorted((r.relative_path, r.type, r.name, r.line_start) for r in state.vectors.collect()) == [("m.js", "block", "", 1), ("m.js", "block", "alpha", 3), ("m.js", "class", "Beta", 7), ("n.txt", "block", "", 1)]
    asked = [{"query_id": 1, "user_id": "u", "project_id": "p", "vector": state.vectors.where("name = 'Beta'").first().embedding}]
    best = vector_index.with_details(vector_index.search(state.vectors, asked, 1), state.vectors).first()
    assert (best["rank"], best.name, best.type, best.language_id, best.line_start, best.line_end, best.relative_path) == (1, "Beta", "class", "javascript", 7, 9, "m.js")
    assert best.summary == "javascript code: class Beta { run() { return 1; } }" and best.hash == sha256(code[code.index("class") :].strip().encode()).hexdigest()


def test_package_reaches_workers_that_lack_it(tmp_path):
    """A sync of a table that no reader of this library made, started where workers don't find the package."""
    script = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parent.parent)!r})
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from loomdex.operators import cache, sync
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
files = spark.createDataFrame([("u", "p", "a.py", "def f():\\n    return 1\\n" * 9, "python")], "user_id string, project_id string, relative_path string, content string, language_id string")
state = sync.State(spark.createDataFrame([], "hash string, summary string, embedding array<float>, expires_at timestamp"), None, spark.createDataFrame([], "user_id string, project_id string, root string"))
print("counted", sync.sync(files, state, F.current_timestamp(), 1)[1].first().received)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "counted" in done.stdout, done.stderr[-3000:]


def test_requests_to_models(spark):
    asked = spark.createDataFrame([(1, ["a", "b"], "go"), (2, ["c"], "go"), (3, None, "go"), (4, ["d"], None), (5, ["slow"], "go"), (6, ["bad"], "go")], "request_id int, texts array<string>, language_id string")

    def complete(prompt, n):
        if "slow" in prompt:
            time.sleep(3)
        if "bad" in prompt:
            raise RuntimeError("no model")
        return "\n".join(f"[{i + 1}] summary number {i + 1}" for i in range(n))

    found = {r.request_id: r for r in models.summarize_requests(asked, complete, EngineConfig(model_timeout=0.5)).collect()}
    assert found[1].summaries == ["summary number 1", "summary number 2"] and found[2].status == 200
    assert (found[3].status, found[3].error) == (400, "chunks array is required") and (found[4].status, found[4].error) == (400, "languageId is required")
    assert found[5].timed_out and found[5].summaries == ["Code chunk"] and found[6].error == "no model" and found[6].summaries == ["Code chunk"]
    texts = spark.createDataFrame([(1, ["one two", "three"]), (2, []), (3, None)], "request_id int, input array<string>")
    told = {r.request_id: r for r in models.embedding_requests(texts, lambda t: [[1.0] * 4], EngineConfig(dimensions=4)).collect()}
    assert [(d["index"], d["embedding"]) for d in told[1].data] == [(0, [1.0] * 4), (1, [0.0] * 4)] and (told[1].prompt_tokens, told[1].total_tokens) == (3, 3)
    assert told[2].status == told[3].status == 400 and told[2].prompt_tokens is None


def fold(hashes):
    while len(hashes) > 1:
        hashes = [sha256("".join(hashes[i : i + 2]).encode()).hexdigest() if i + 1 < len(hashes) else hashes[i] for i in range(0, len(hashes), 2)]
    return hashes[0]


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 10, 255, 256, 257, 700])
def test_merkle_roots(spark, n):
    names = [f"src/{i:04d}.ts" for i in range(n)]
    files = spark.createDataFrame([("p", x, f"content {x}") for x in reversed(names)], "project_id string, relative_path string, content string")
    expected = fold([sha256(f"{x}content {x}".encode()).hexdigest() for x in names])
    found = merkle.roots(merkle.leaves(files)).first()
    assert (found.project_id, found.root, found.n_files) == ("p", expected, n)
    if n <= 10:
        top = merkle.nodes(merkle.leaves(files)).orderBy(F.desc("level")).first()
        assert top.hash == expected


def test_merkle_levels_of_one_large_project(spark):
    """A project's nodes are dealt over tasks by runs of leaves, not by project, and all levels are there."""
    n = 600
    files = spark.createDataFrame([("p", f"f{i:04d}", str(i)) for i in range(n)] + [("q", "a", "1"), (None, "a", "1"), (None, "b", "2")], "project_id string, relative_path string, content string")
    found = merkle.nodes(merkle.leaves(files))
    got = {(r.project_id, r.level, r.idx): r.hash for r in found.collect()}
    level, want = [sha256(f"f{i:04d}{i}".encode()).hexdigest() for i in range(n)], {}
    for k in range(11):
        want |= {("p", k, i): h for i, h in enumerate(level)}
        level = [sha256("".join(level[i : i + 2]).encode()).hexdigest() if level[i + 1 : i + 2] else level[i] for i in range(0, len(level), 2)]
    assert {k: v for k, v in got.items() if k[0] == "p"} == want and len(want) == 600 + 300 + 150 + 75 + 38 + 19 + 10 + 5 + 3 + 2 + 1
    assert [k for k in got if k[0] == "q"] == [("q", 0, 0)] and {k[1:] for k in got if k[0] is None} == {(0, 0), (0, 1), (1, 0)}
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()  # no level is dealt by its project


def test_merkle_order_and_changes(spark):
    files = spark.createDataFrame([("p", x, "c") for x in ("b", "A", "a", "_", "B")], "project_id string, relative_path string, content string")
    tree = merkle.leaves(files)
    assert [r.relative_path for r in merkle.in_order(tree).orderBy("idx").collect()] == ["_", "a", "A", "b", "B"]
    none = merkle.roots(tree.limit(0))
    assert none.count() == 0
    other = merkle.leaves(files.where("relative_path <> 'b'").withColumn("content", F.when(F.col("relative_path") == "a", "d").otherwise("c")))
    status = {r.relative_path: r.status for r in merkle.diff(tree, other).collect()}
    assert status == {"b": "removed", "a": "modified", "A": "unchanged", "_": "unchanged", "B": "unchanged"}


def test_root_check(spark):
    client = spark.createDataFrame([("u", "a", "r"), ("u", "b", "r"), ("u", "c", "r")], "user_id string, project_id string, root string")
    server = spark.createDataFrame([("u", "a", "r"), ("u", "b", "x"), ("v", "c", "r")], "user_id string, project_id string, root string")
    found = {r.project_id: (r.changed, r.server_root) for r in merkle.check_roots(client, server).collect()}
    assert found == {"a": (False, "r"), "b": (True, "x"), "c": (True, None)}


def test_positions(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    got = with_positions(rows, ["k"], [F.col("v")]).collect()
    for k in range(3):
        mine = sorted((r.v, r.idx) for r in got if r.k == k)
        assert [i for _, i in mine] == list(range(len(mine)))


def test_tenants_in_search(spark):
    near = [("t1", f"n{i:02d}", [1.0, 0.01 * i]) for i in range(25)]
    index = spark.createDataFrame([*near, ("t2", "far", [0.0, 1.0]), ("t2", "zero", [0.0, 0.0])], "tenant string, id string, embedding array<float>")
    ask = [{"query_id": 1, "tenant": "t2", "vector": [1.0, 0.0]}]
    assert vector_index.search(index, ask, 10, EngineConfig(search_mode="faithful"), ("tenant",)).collect() == []
    exact = vector_index.search(index, ask, 10, EngineConfig(), ("tenant",)).collect()
    assert [(r.rank, r.id, r.score) for r in exact] == [(1, "far", 0.0)]
    capped = vector_index.search(index, [{**ask[0], "tenant": "t1"}], 50, EngineConfig(search_mode="faithful"), ("tenant",))
    assert capped.count() == 20
    assert vector_index.search(index, [{**ask[0], "vector": [0.0, 0.0]}], 5, EngineConfig(), ("tenant",)).count() == 0


def brute_search(rows, asked, k, mode):
    """Rows by cosine, ties by id."""
    out = []
    for n, _, tenant, v in asked:
        score = lambda e: round(sum(x * y for x, y in zip(v, e, strict=True)) / (sum(x * x for x in v) * sum(y * y for y in e)) ** 0.5, 12)  # noqa: B023, E731
        every = sorted((-score(r[3]), r[1], r[2]) for r in rows if any(r[3]) and any(v))
        first = [r for r in every if r[2] == tenant][:k] if mode == "exact" else [r for r in every[: min(3 * k, 20)] if r[2] == tenant][:k]
        out += [(n, i + 1, r[1], round(-r[0], 6) + 0.0) for i, r in enumerate(first) if tenant is not None]
    return sorted(out)


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_search_of_many_queries(spark, monkeypatch, limit):
    """Many rows ask, sent to all tasks or in several blocks, with ties, zero vectors and null tenants: as by brute force."""
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 50)
    monkeypatch.setattr(vector_index, "BROADCAST_LIMIT_BYTES", limit)
    rows = [(i, f"{i:04d}", None if i % 29 == 0 else f"t{i % 3}", [float(i * 7 % 11), float(i * 5 % 13) - 6, float(i % 2)]) for i in range(120)]
    index = spark.createDataFrame(rows + [(500, "0500", "t1", [0.0, 0.0, 0.0])], "n long, id string, tenant string, embedding array<float>").cache()
    asked = index.where("n % 15 = 0 or n = 500")
    every = rows + [(500, "0500", "t1", [0.0, 0.0, 0.0])]
    wanted = [r for r in every if r[0] % 15 == 0 or r[0] == 500]
    for mode in ("exact", "faithful"):
        many = vector_index.search_all(index, asked.selectExpr("n as query_id", "tenant", "embedding as vector"), 6, EngineConfig(search_mode=mode), ("tenant",))
        assert sorted(map(tuple, many.collect())) == brute_search(every, wanted, 6, mode)


def test_search_holds_no_matrix_of_all_pairs(monkeypatch):
    """What a worker holds of many queries and a batch is bounded, copies and ties included, and it finds what brute force finds."""
    import tracemalloc

    import pyarrow as pa

    n, rng = 4000, np.random.default_rng(2)
    x = rng.normal(size=(n, 8)).astype(np.float32).astype(float)
    x[::2] = x[0]  # half of all rows are copies
    names, keys = [f"{i * 37 % n:05d}" for i in range(n)], [f"t{i % 2}" if i % 7 else None for i in range(n)]
    asked = pa.table({"query_id": names, "key": keys, "vec": list(x)})
    for exact in (True, False):
        tracemalloc.start()
        best = vector_index._Best(asked, 5, exact)
        for at in range(0, n, 1500):
            best.add(asked.rename_columns(["id", "key", "vec"]).slice(at, 1500))
        assert tracemalloc.get_traced_memory()[1] < 100 << 20  # a matrix of all pairs takes 128 MB
        tracemalloc.stop()
        got = best.found().to_pylist()
        for i in (0, 1, 2, 7, 1999):
            score = np.round((x * x[i]).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((x[i] * x[i]).sum())), 12)
            of = [j for j in range(n) if not exact or keys[i] is not None and keys[j] == keys[i]]
            want = sorted((-score[j], names[j], keys[i] is not None and keys[j] == keys[i]) for j in of)[:5]
            assert sorted((-r["score"], r["id"], r["mine"]) for r in got if r["query_id"] == names[i]) == want


def test_code_is_written_once(spark, empty, monkeypatch):
    """Looked-up rows and new entries go without code, and vectors are written once; deletions and copies come out as before."""
    written, materialize = [], sync.materialize
    monkeypatch.setattr(sync, "materialize", lambda df, name="table": (written.append((name, df.columns)), materialize(df, name))[1])
    body = "\n".join(f"line {i} of some text that is long enough to be kept" for i in range(10))
    files = spark.createDataFrame([("u", "p", "a.txt", body, "text"), ("u", "p", "b.txt", body, "text"), ("v", "p", "a.txt", body + " v", "text")], "user_id string, project_id string, relative_path string, content string, language_id string")
    state, counts = sync.sync(files, empty, cache.literal_time(NOW), 1, CONFIG)
    assert [name for name, columns in written if "code" in columns] == ["chunks"]
    assert [name for name, columns in written if "summary" in columns] == ["made", "vectors", "cache"]
    assert {(r.user_id, r.received, r.processed, r.stored) for r in counts.collect()} == {("u", 2, 2, 1), ("v", 1, 1, 1)}
    assert {(r.user_id, r.relative_path) for r in state.vectors.collect()} == {("u", "b.txt"), ("v", "a.txt")}
    again, _ = sync.sync(files.withColumn("content", F.concat("content", F.lit("!"))), state, cache.literal_time(NOW), 2, CONFIG)
    assert again.vectors.count() == 2 and again.vectors.join(state.vectors, "id").count() == 0 and again.cache.count() == 4


def test_vector_ids(spark):
    ids = spark.createDataFrame([("user-alice", "project-one", "h" * 64), ("a_b", "p", "hash")], "u string, p string, h string")
    short = hashing.vector_id(F.col("u"), F.col("p"), F.col("h"))
    got = ids.select(short, hashing.hash_of_vector_id(short), hashing.vector_id(F.col("u"), F.col("p"), F.col("h"), True)).collect()
    assert got[0][0] == f"user-ali_project-_{'h' * 16}" and got[0][1] == "h" * 16 and got[0][2] == f"user-alice_project-one_{'h' * 64}"
    assert got[1][1] == "p"  # a prefix with the separator shifts the parts


def test_refused_requests(spark):
    rows = [(None,), ("Basic x",), ("Bearer x",), ("Bearer dev-token-",), ("Bearer dev-token-u1",)]
    got = spark.createDataFrame(rows, "h string").select(requests.auth_error(F.col("h")), requests.user_of(F.col("h"))).collect()
    assert len({r[0] for r in got}) == 5 and got[-1][:] == (None, "u1")


def test_watch(spark, tmp_path):
    leaves = merkle.leaves(spark.createDataFrame([("p", "a.ts", "1"), ("q", "b.ts", "1")], "project_id string, relative_path string, content string"))
    told = []
    where = str(tmp_path / "watch")
    watch = MerkleWatch(leaves, lambda roots: told.append(sorted(r.project_id for r in roots.collect())), folder=where)

    def batch(*rows):
        return spark.createDataFrame(rows, "project_id string, path string, event_type string, content string, ts int, event_id int")

    watch(batch(("p", "a.ts", "update", "1", 1, 1), ("q", "node_modules/x.ts", "create", "9", 1, 2), ("q", "x.md", "create", "9", 1, 3)), 0)
    assert told == []
    watch(batch(("p", "a.ts", "update", "2", 2, 4), ("q", "c.ts", "create", "1", 2, 5), ("q", "c.ts", "delete", None, 3, 6)), 1)
    assert told == [["p"]]
    watch = MerkleWatch(leaves.limit(0), watch.on_changed, folder=where)  # a new driver on the same folder
    watch(batch(("q", "b.ts", "delete", None, 4, 7)), 2)
    assert told == [["p"]] and watch.roots.where("project_id = 'q'").first().root == ""
    events = batch(("p", "n.ts", "update", "1", 1, 1), ("p", "n.ts", "create", "1", 2, 2), ("p", "n.ts", "delete", "1", 3, 3), ("p", "n.ts", "delete", "1", 4, 4))
    assert [r.reported for r in first_creations(events).orderBy("ts").collect()] == ["create", "update", "delete"]


EVENT = "project_id long, path string, event_type string, ts timestamp, event_id long"


def test_streams_go_on_after_a_restart(spark, tmp_path):
    """Each run takes what has come with a new sink on the same folders; a batch that fails halfway is repeated."""
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    events = [(1, f"f{i % 7}", "sync" if i == 20 else "update", f"2024-01-01 00:{i:02d}:00", i) for i in range(40)]
    rows = spark.createDataFrame(events, "project_id long, path string, event_type string, t string, event_id long").select("project_id", "path", "event_type", F.to_timestamp("t").alias("ts"), "event_id")
    broken = []
    for at in range(0, 40, 8):
        rows.where(f"event_id between {at} and {at + 7}").coalesce(1).write.mode("append").parquet(log)
        stream = spark.readStream.schema(EVENT).parquet(log)
        fold = DirtyFold(spark, state)

        def fails(batch, batch_id, fold=fold):
            fold(batch, batch_id)
            broken.append(batch_id)
            raise RuntimeError("driver lost")

        if at == 16:
            with pytest.raises(StreamingQueryException):
                drain(stream, fails, str(tmp_path / "checkpoint"))
            fold = DirtyFold(spark, state)
        drain(stream, fold, str(tmp_path / "checkpoint"))
    assert broken == [2]
    assert sorted(map(tuple, DirtyFold(spark, state).dirty().collect())) == sorted(map(tuple, dirty_since_sync(rows).collect()))


def test_periodic_trigger(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.ts", "update", 1)], "project_id long, path string, event_type string, event_id long").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    rows.select("project_id", "path", "event_type", "ts", "event_id").write.parquet(str(tmp_path / "log"))
    told, fold = [], DirtyFold(spark, str(tmp_path / "state"))
    query = watch_stream(spark.readStream.schema(EVENT).parquet(str(tmp_path / "log")), periodic_sync(fold, lambda dirty: told.append(dirty.count())), str(tmp_path / "c"), "1 second")
    for _ in range(100):
        if told:
            break
        time.sleep(0.2)
    query.stop()
    assert told == [1]


def test_log_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_module, "COMPACT", 3)
    log = log_module.BatchLog(spark, str(tmp_path), "k string, v int", lambda rows: latest_by_key(rows, ["k"], ["batch_id"]))
    batch = lambda n: spark.createDataFrame([(f"k{n % 3}", n)], "k string, v int")
    for n in range(-1, 9):
        log.append(n, batch(n))
        if n == 5:
            log.append(n, batch(n))
        assert {r.k: r.v for r in log.rows().collect()} == {f"k{i % 3}": i for i in range(-1, n + 1)}
        assert {r.k: r.v for r in log.rows(before=n).collect()} == {f"k{i % 3}": i for i in range(-1, n)}
    assert len(list(tmp_path.glob("b*"))) <= 5 and log_module.BatchLog(spark, str(tmp_path), "k string, v int", log.fold).last() == 8


def test_tree_and_state(spark, tmp_path):
    for name, body in {"src/a.ts": "let a", "node_modules/b.ts": "x", "src/c.md": "x", "d.js": "é"}.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_text(body)
    got = file_tree.scan(spark, str(tmp_path / "tree"), "p").orderBy("relative_path").collect()
    assert [(r.relative_path, r.content, r.language_id) for r in got] == [("d.js", "é", "javascript"), ("src/a.ts", "let a", "typescript")]
    where = str(tmp_path / "project")
    assert file_tree.load_latest(spark, where) is None
    made = file_tree.get_or_create_project(spark, where).first().project_id
    assert file_tree.get_or_create_project(spark, where).first().project_id == made
    file_tree.save_version(file_tree.load_latest(spark, where), where, 2)
    for part in (tmp_path / "project" / "version=2").glob("*.parquet"):
        part.write_bytes(b"not a table")
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    with pytest.warns(UserWarning, match="version 2"):
        assert file_tree.load_latest(spark, where).first().project_id == made
    cached = file_tree.content_cache(file_tree.scan(spark, str(tmp_path / "tree"), "p"))
    assert [r.relative_path for r in file_tree.without(cached, cached.where("relative_path = 'd.js'")).collect()] == ["src/a.ts"]
    assert file_tree.without(cached).count() == 0
    (tmp_path / "r.json").write_text('{"projectId": "p"}\n{bad\n')
    read = file_tree.requests(spark, str(tmp_path / "r.json"), "projectId string").collect()
    assert sorted((r.projectId or "", r._corrupt is None) for r in read) == [("", False), ("p", True)]
