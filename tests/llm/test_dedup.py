"""SimHash, substring and exact dedup against brute force."""

import re
from hashlib import sha256

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdex.llm import exact_dedup, simhash, simhash_wide, substring_dedup
from loomdex.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]+")
LAST = 2**63


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_fingerprint(text, k=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = words_of(lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, ids, radius):
    label = list(range(len(prints)))
    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(prints))]


def test_simhash(docs, rows, empty):
    prints = [plain_fingerprint(r[1]) for r in rows]
    comps = plain_components(prints, [r[0] for r in rows], 4)
    expected = sorted((str(r[0]), f"{p:016x}", str(c)) for r, p, c in zip(rows, prints, comps, strict=True))
    found = simhash.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), f"{r.fp & (2**64 - 1):016x}", str(r.component_id)) for r in found) == expected
    assert simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("segments", [2, 3, 4])
def test_multi_index_finds_every_component(spark, segments):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 60, dtype=np.int64)
    prints = set(centres.tolist())
    for c in centres.tolist():
        for _ in range(6):
            flips = rng.choice(63, rng.integers(1, 7), replace=False)
            prints.add(c ^ sum(1 << int(b) for b in flips))
    prints = sorted(prints)
    links = simhash.similar_fingerprints(spark.createDataFrame([(p,) for p in prints], "fp long"), 4, segments)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    expected = plain_components(prints, list(range(len(prints))), 4)
    groups = {}
    for p, e in zip(prints, expected, strict=True):
        groups.setdefault(e, set()).add(roots.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)
    assert [simhash.segments_for(n) for n in (0, 1, 1000, 240_000, 15_000_000, 10**10)] == [4, 4, 4, 4, 3, 2]


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 101), (200, 150), (200, 160), (160, 200)]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100 and found[200] == found[160] == 150
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_leave_one(docs, rows):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    prints = {plain_fingerprint(r[1]) for r in rows}
    comps = plain_components(sorted(prints), list(range(len(prints))), 4)
    assert kept.count() == len(set(comps))
    assert {r.doc_id for r in kept.where("doc_id between 100 and 112").collect()} == {100}


def _edited(rng, words, n):
    out = list(words)
    for i in rng.choice(len(out), n, replace=False):
        out[i] = f"edit{rng.integers(1 << 40)}"
    return out


def _jaccard(a, b):
    a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
    return len(a & b) / len(a | b)


def test_wide_fingerprints_tell_similarity(spark, monkeypatch):
    """Pairs of 0.85 and more meet, pairs under 0.65 don't; also where parts are dealt into blocks."""
    rng = np.random.default_rng(9)
    texts = []
    for i in range(60):
        base = [f"t{i}w{j}" for j in rng.integers(0, 400, 300)]
        texts += [(base, i, 1.0), (_edited(rng, base, 3), i, 0.9), (_edited(rng, base, 30), i, 0.4)]
    data = [(n, " ".join(t)) for n, (t, _, _) in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for part, block in ((25_000, 20_000), (20, 7)):
        monkeypatch.setattr(simhash_wide, "PART", part)
        monkeypatch.setattr(simhash_wide, "BLOCK", block)
        found = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(df).collect()}
        for i in range(0, 180, 3):
            assert _jaccard(texts[i][0], texts[i + 1][0]) > 0.85 and _jaccard(texts[i][0], texts[i + 2][0]) < 0.65
            assert found[i] == found[i + 1] == i and found[i + 2] == i + 2


@pytest.mark.parametrize("verified", [500, 20])
def test_wide_links_are_exact(spark, monkeypatch, verified):
    """Components equal those of brute force at similarities around the limit, in small components and in dealt ones."""
    monkeypatch.setattr(simhash_wide, "VERIFIED", verified)
    rng = np.random.default_rng(11)
    texts = []
    for i in range(200):
        base = [f"p{i}w{j}" for j in range(304)]
        texts += [base, _edited(rng, base, int(rng.integers(5, 10)))]
    base = [f"q{j}" for j in range(304)]
    for _ in range(25):  # one component of candidates, of several components
        centre = _edited(rng, base, int(rng.integers(0, 9)))
        texts += [_edited(rng, centre, int(rng.integers(0, 4))) for _ in range(4)]
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    label = list(range(len(texts)))
    near = 0
    for i in range(len(texts)):
        for j in range(i):
            s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            near += 0.7 <= s < 0.8
            if s >= 0.8 and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for n, x in enumerate(label):
        least.setdefault(x, n)
    assert near > 50 and len(least) < len(texts) - 100
    df = spark.createDataFrame([(n, " ".join(t)) for n, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash_wide.near_duplicates(df).collect()}
    assert found == {n: least[x] for n, x in enumerate(label)}


def test_wide_candidates_do_not_depend_on_size(spark, monkeypatch):
    """Of pairs as far apart as at 0.8 nearly all are found, the same ones however many parts the index has."""
    rng = np.random.default_rng(12)
    data = []
    for i in range(1500):
        bits = rng.integers(0, 2, simhash_wide.BITS, dtype=np.uint8)
        other = bits.copy()
        other[rng.choice(simhash_wide.BITS, simhash_wide.farthest(0.8) - 21 + i % 10, replace=False)] ^= 1
        data += [(2 * i + n, bytearray(np.packbits(b).tobytes())) for n, b in enumerate((bits, other))]
    df, found = spark.createDataFrame(data, "v long, sig binary"), []
    for part in (25_000, 1500, 94, 6):
        monkeypatch.setattr(simhash_wide, "PART", part)
        found.append({(min(r), max(r)) for r in map(tuple, simhash_wide.similar_signatures(df, 0.8).distinct().collect())})
    assert all(f == found[0] for f in found)
    assert len(found[0]) >= 1490 and all(v == u + 1 and u % 2 == 0 for u, v in found[0])


def test_wide_links_of_a_dense_group_are_few(spark):
    rng = np.random.default_rng(10)
    base = [f"w{j}" for j in range(300)]
    copies = [" ".join(_edited(rng, base, 2)) for _ in range(400)]
    data = [(n, bytearray(simhash_wide.signature(simhash_wide.shingle_set(t, 5)))) for n, t in enumerate(copies)]
    links = simhash_wide.similar_signatures(spark.createDataFrame(data, "v long, sig binary"), 0.8)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    assert len(set(roots.values())) == 1 and len(roots) >= 398  # roots have no row of their own; two edits may leave a copy apart
    assert links.count() <= simhash_wide.SEGMENTS * 400


def test_wide_on_awkward_rows(docs, rows, empty):
    found = simhash_wide.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    of = {}
    for r in found:
        of.setdefault(r.doc_id, set()).add(r.component_id)
    assert of[100] == of[105] == of[110] == of[111] == of[112] == {100}
    assert of[130] == of[131] == of[132] == {130} and of[None] == {100, 130} and of[133] == {133}
    kept = simhash_wide.drop_near_duplicates(docs)
    # The two texts of 141 are components of one least doc_id.
    assert kept.columns == docs.columns and kept.count() == len({c for s in of.values() for c in s}) + 1
    assert simhash_wide.near_duplicates(empty).count() == simhash_wide.drop_near_duplicates(empty).count() == 0


def test_substrings(docs, rows, empty):
    ids = [LAST if r[0] is None else r[0] for r in rows]
    least = {}
    for i, r in zip(ids, rows, strict=True):
        w = words_of(r[1])
        for p in range(len(w) - 12):
            k = tuple(w[p : p + 13])
            least[k] = min(least.get(k, i), i)
    expected = []
    for i, r in zip(ids, rows, strict=True):
        w = words_of(r[1])
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if least[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected.append((str(r[0]), len(w), sum(gone), kept))
    found = substring_dedup.dedup_substrings(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in found) == sorted(expected)
    for r in found:
        assert sum(f["words"] for f in r.factors) >= r.n_removed and all(f["words"] >= 13 for f in r.factors)
    assert substring_dedup.dedup_substrings(empty).count() == 0


@pytest.mark.parametrize("fan", [16_384, 3])
def test_substring_factors_are_copies_of_their_places(spark, docs, rows, monkeypatch, fan):
    """Small blocks and buckets, one round or two: each factor is word by word what stands at its place, in a smaller doc_id."""
    small = sorted(map(str, substring_dedup.dedup_substrings(docs).drop("factors").collect()))
    monkeypatch.setattr(substring_dedup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(substring_dedup, "BUCKET_ENTRIES", 10)
    monkeypatch.setattr(substring_dedup, "FAN", fan)
    blocks = substring_dedup.block_table(docs)
    stored = blocks.collect()
    words = {r.block: [w for t in r.texts for w in words_of(t)] for r in stored}
    owner = {r.block: [i for i, t in zip(r.ids, r.texts, strict=True) for _ in words_of(t)] for r in stored}
    found = substring_dedup.parsed(blocks).collect()
    assert sorted(str(r) for r in substring_dedup.parsed(blocks).drop("factors").collect()) == small
    texts = {}
    for r in rows:
        texts.setdefault(r[0], []).append(words_of(r[1]))
    seen = 0
    for r in found:
        for f in r.factors:
            place = words[f["block"]][f["position"] : f["position"] + f["words"]]
            assert any(t[f["first"] : f["first"] + f["words"]] == place for t in texts[r.doc_id] if len(t) == r.n_words)
            assert len(place) == f["words"] >= 13
            assert max(owner[f["block"]][f["position"] : f["position"] + f["words"]]) < (2**63 - 1 if r.doc_id is None else r.doc_id)
            seen += 1
        assert sum(f["words"] for f in r.factors) >= r.n_removed
    assert seen > 10


def test_hot_passages(spark, monkeypatch):
    """A passage in every document, in blocks of a few: all but the first lose it, and nothing else; the parse is greedy."""
    monkeypatch.setattr(substring_dedup, "BLOCK_DOCS", 3)
    monkeypatch.setattr(substring_dedup, "FAN", 20)
    passage = " ".join(f"p{i}" for i in range(40))
    data = [(n, f"{' '.join(f'd{n}w{i}' for i in range(20))} {passage} {' '.join(f'd{n}v{i}' for i in range(5))}") for n in range(300)]
    found = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found[0].n_removed == 0 and all(found[n].n_removed == 40 for n in range(1, 300))
    assert all([(f["first"], f["words"]) for f in found[n].factors] == [(20, 40)] for n in range(1, 300))


def test_windows_across_borders_of_factors(spark):
    """A text of two halves that stand in two documents, and a border passage that stands in a third."""
    w = [f"w{i}" for i in range(60)]
    data = [(1, " ".join(w[:30])), (2, " ".join(w[30:])), (3, " ".join(["x"] + w[23:38])), (4, " ".join(w)), (5, " ".join(w[20:33] + ["y"]))]
    found = {r.doc_id: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert [found[i].n_removed for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 60, 13]
    assert [(f["first"], f["words"]) for f in found[4].factors] == [(0, 30), (23, 15), (30, 30)]


def expected_groups(rows):
    texts = [SPACE.sub(" ", r[1] or "") for r in rows]
    groups = {}
    for t, r in zip(texts, rows, strict=True):
        groups.setdefault(t, []).append(r[0])
    out = []
    for t, r in zip(texts, rows, strict=True):
        ids = [i for i in groups[t] if i is not None]
        out.append((str(r[0]), str(min(ids) if ids else None), len(groups[t]), sha256(t.encode()).hexdigest()))
    return sorted(out), len(groups)


@pytest.mark.parametrize("identifier", [F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(5))])
def test_exact(docs, rows, empty, identifier):
    """A hash of five values makes identifiers clash everywhere; verification keeps the groups apart."""
    found = exact_dedup.duplicate_groups(docs, identifier).collect()
    expected, n = expected_groups(rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in found) == expected
    kept = [r for r in found if r.kept]
    assert len(kept) == n and all(r.doc_id == r.keep_id for r in kept)
    assert exact_dedup.duplicate_groups(empty).count() == 0


def test_exact_keeps_one_row(docs, rows, empty):
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == expected_groups(rows)[1]
    assert kept.where("doc_id = 140").count() == 1 and kept.where("doc_id = 141").count() == 2
    assert exact_dedup.drop_duplicates(empty).count() == 0


def test_chunks_are_cut_by_content(spark):
    rng = np.random.default_rng(1)
    long = " ".join("".join(rng.choice(list("abdegkmnorsty"), 6)) for _ in range(3000)) + " end. " + "x" * 20_000
    df = spark.createDataFrame([(1, long), (2, "shift. " + long)], "doc_id long, text string")
    cut = df.select(F.regexp_extract_all("text", F.lit(exact_dedup.CHUNK), F.lit(0)).alias("c")).collect()
    assert "".join(cut[0].c) == long and max(map(len, cut[0].c)) <= 8192
    assert len(set(cut[0].c) & set(cut[1].c)) > 3
