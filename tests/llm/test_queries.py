"""The queries opN_<name>: what they derive from their operators, on the driver's smallest tables."""

import zlib
from hashlib import sha256

import pytest

from loomdex.llm import queries
from loomdex.sources import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}


def test_fingerprints_are_hex(spark, documents):
    found = queries.op1_simhash_near_dedup(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents)
    assert all(len(r.fingerprint) == 16 and r.fingerprint == f"{int(r.fingerprint, 16):016x}" and r.component_id <= r.doc_id for r in found)


def test_decoded_texts_come_back(spark, documents):
    found = queries.op9_sentencepiece(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents)
    assert all(r.decoded_sha256 == sha256((documents[r.doc_id] or "").replace("▁", " ").encode()).hexdigest() for r in found)


def test_quality_of_held_out_rows(spark, documents):
    found = queries.op8_quality(spark, SF).collect()
    assert sorted(r.doc_id for r in found) == sorted(documents)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_neighbours_are_asked_by_every_twentieth(spark):
    ids = [r.vec_id for r in table(spark, SF, "embeddings").select("vec_id").collect()]
    found = queries.op6_nearest_neighbours(spark, SF).collect()
    of = {}
    for r in found:
        of.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(of) == sorted(i for i in ids if i % 20 == 0)
    for q, rows in of.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 21)) and all(v != q for _, v, _ in rows)
        assert rows == [(n + 1, *r) for n, r in enumerate(sorted(((v, s) for _, v, s in rows), key=lambda r: (-r[1], r[0])))]


def test_mix_and_licenses_have_a_row_a_document(spark, documents):
    mixed = queries.op5_source_mixing(spark, SF).collect()
    assert sorted(r.doc_id for r in mixed) == sorted(documents) and all(0 <= r.taken <= 3 * r.size for r in mixed)
    scanned = queries.op3_license_scan(spark, SF)
    assert scanned.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(r.doc_id for r in scanned.collect()) == sorted(documents)
