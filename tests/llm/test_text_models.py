"""License scans, token counts, SentencePiece coding, and both classifiers."""

import re
import zlib

import numpy as np
import pytest
import sentencepiece

from loomdex.llm import labelled, license_scan, quality, sentencepiece_codec, token_count, toxicity
from loomdex.llm.unigram import Segmenter, _fields, read_vocabulary

MODEL = token_count.read_model()


def test_license_base(docs, rows, empty):
    phrases = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
    expected = []
    for r in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        at = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        expected.append((str(r[0]), len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    found = license_scan.scan(docs).collect()
    assert sorted(map(str, expected)) == sorted(str((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in found)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found)
    assert license_scan.scan(empty).count() == 0


def test_license_templates(spark):
    mit, gpl = license_scan.TEMPLATES[1][1], next(t for l, t in license_scan.TEMPLATES if l == "gpl-3")
    broken = mit.replace("free of charge", "at no charge whatever").replace("sublicense", "re-license")
    data = [(1, f"intro words here. {mit} more"), (2, f"x {broken} y"), (3, mit[:120]), (4, "nothing of the kind at all"), (5, f"{gpl} {gpl}")]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert found[1].labels == "mit" and found[1].score == 1 and found[1].base_labels == ""
    assert found[2].labels == "mit" and 0.6 <= found[2].score < 1
    assert found[3].labels == found[4].labels == "" and found[4].score == 0
    assert found[5].labels == "gpl-3"
    words = license_scan.words_of(data[0][1])
    span = found[1].spans[0]
    assert words[span["first"]] == b"permission"


def _flipped_to_unigram(model: bytes) -> bytes:
    """The same vocabulary as a model of the library's unigram type, scores of -1e9 made -40000 so that 32-bit sums are exact."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def encode(number, value):
        if isinstance(value, int):
            return varint(number << 3) + varint(value)
        if len(value) == 4 and number in (2, 10, 15, 51):
            return varint(number << 3 | 5) + value
        return varint(number << 3 | 2) + varint(len(value)) + value

    out = b""
    for number, value in _fields(model):
        if number == 1:
            value = value.replace(struct.pack("<f", -1e9), struct.pack("<f", -40000.0))
        if number == 2:
            value = b"".join(encode(n, 1 if n == 3 else v) for n, v in _fields(value))
        out += encode(number, value)
    return out


@pytest.fixture(scope="module")
def unigram():
    raw = _flipped_to_unigram(MODEL)
    return Segmenter(read_vocabulary(raw)), sentencepiece.SentencePieceProcessor(model_proto=raw)


SAMPLES = ["", " ", "a", "  Hello   wörld\n\tx ", "日本語 テスト", "naïve 😀 café\r\n", "x" * 300, "\n\n a", "the theatre, hest lere", "a▁b", " nbsp"]


def test_equals_library(unigram, rows):
    ours, library = unigram
    texts = SAMPLES + [r[1][:2000] for r in rows if r[1]]
    for t in texts:
        expected = library.encode(t)
        assert ours.encode(t) == expected, t
        assert ours.count(t) == len(expected)
        assert ours.decode(np.array(expected)) == library.decode(expected)


def test_chunks_equal_whole():
    """Transfer matrices, their scan, and the traces of chunks against one Viterbi pass."""
    s, rng = Segmenter(read_vocabulary(MODEL)), np.random.default_rng(5)
    size = s.vocabulary.longest
    for n in range(60):
        text = "".join(rng.choice(list("abthe \n日éin"), rng.integers(20, 300)))
        whole = s.prefixed(text.replace(" ", "") if n % 3 == 0 else text)
        chunks = [sentencepiece_codec.Chunk(s, p, left) for _, p, left in sentencepiece_codec._split(whole, int(rng.choice([16, 20, 50])), size)]
        start = np.full(size, sentencepiece_codec.NEVER, np.int64)
        start[-1] = 0
        scores = [start, *(sentencepiece_codec.combine(start, m) for m in sentencepiece_codec.scan([c.matrix() for c in chunks[:-1]]))]
        maps, leave = [c.entries(v) for c, v in zip(chunks, scores, strict=True)], [size - 1]
        for m in maps[:0:-1]:
            leave.append(int(m[leave[-1]]))
        ids = [i for c, v, z in zip(chunks, scores, leave[::-1], strict=True) for i in c.ids(v, z)]
        _, back, piece = s.forward(whole)
        assert ids == s.ids_of(whole, s.path(whole, back, piece, len(whole))[1])


def test_count_and_codec(docs, rows, empty):
    s = Segmenter(read_vocabulary(MODEL))
    counts = sorted((str(r.doc_id), r.n_tokens) for r in token_count.count_tokens(docs).collect())
    assert counts == sorted((str(r[0]), len(s.encode(r[1]))) for r in rows)
    coded = sentencepiece_codec.encode(docs, giant=500, chunk=64)
    found = coded.collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in found) == sorted((str(r[0]), s.encode(r[1])) for r in rows)
    back = sentencepiece_codec.decode(coded).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    both = sentencepiece_codec.round_trip(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in both) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert token_count.count_tokens(empty).count() == sentencepiece_codec.encode(empty).count() == 0


def test_frequent_texts_stay_remembered():
    from loomdex.llm.words import Remembered

    made = []
    known = Remembered(lambda t: made.append(t) or len(t), most=3, longest=4)
    for t in ("a", "b", "c", "a", "d", "a", "e", "f", "a", "longer", "longer"):
        assert known[t] == len(t)
    assert made.count("a") == 1 and made.count("longer") == 2 and len(known) <= 3


def test_without_bytes_unknowns_merge():
    v = read_vocabulary(MODEL)
    v.bytes_ = None
    s = Segmenter(v)
    assert s.encode("日\U0001f600\U0001f601x")[1:3].count(v.unknown) <= 1 and s.count("\U0001f600\U0001f601") == len(s.encode("\U0001f600\U0001f601"))


def _held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("module", "threshold"), [(toxicity, 0.5), (quality, 0.3)])
def test_classifier_tables(docs, rows, empty, labels, module, threshold):
    first, again = ({(str(r.doc_id), r.score) for r in module.classify(docs, labels).collect()} for _ in range(2))
    assert first == again
    found = module.classify(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) and r.held_out == _held_out(r.doc_id)
    assert module.classify(empty, labels).count() == 0
    assert all(0 <= r.score <= 1 for r in module.classify(docs, labels.limit(0)).collect())
    one = module.classify(docs, labels.where("toxic = 1 and quality = 1")).collect()
    assert all(r.score > 0.99 for r in one)


def test_classifiers_do_not_see_held_out_labels(docs, labels):
    """Turning all held-out labels over changes no score."""
    from pyspark.sql import functions as F

    from loomdex.llm.labelled import held_out

    out = held_out(F.col("doc_id"))
    turned = labels.withColumns({c: F.when(out, 1 - F.col(c)).otherwise(F.col(c)) for c in ("toxic", "quality")})
    for module in (toxicity, quality):
        a, b = ({(str(r.doc_id), r.score) for r in module.classify(docs, x).collect()} for x in (labels, turned))
        assert a == b


def test_toxicity_learns_and_generalises():
    rng = np.random.default_rng(1)
    words = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ne") for b in ("lu", "ka", "si") for c in ("d", "n", "ren", "st")]
    bad = ["blorgh", "snarkel", "vileness"]
    bags, y = [], []
    for i in range(400):
        bag = set(rng.choice(words, 25))
        if i % 4 == 0:
            bag |= set(rng.choice(bad, 2))
        bags.append(sorted(bag))
        y.append(int(i % 4 == 0))
    model, bias = toxicity.train(bags[:300], np.array(y[:300]))
    table = toxicity.WordScores(model)
    found = [toxicity.score_text(" ".join(b), table, bias) >= 0.5 for b in bags[300:]]
    assert np.mean([f == bool(t) for f, t in zip(found, y[300:], strict=True)]) > 0.95
    clean = " ".join(words[:25])
    # Misspellings that were never seen share n-grams with the words that were.
    assert toxicity.score_text(clean + " blorghh snarkell vilenes", table, bias) > toxicity.score_text(clean, table, bias)


def test_quality_tables_learn_interactions():
    rng = np.random.default_rng(2)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(int)
    model = quality.train(x[:2000], y[:2000])
    assert np.mean((model.scores(x[2000:]) >= 0.5) == y[2000:]) > 0.9
    assert {frozenset(p[:2]) for p in model.pairs} >= {frozenset((0, 1))}
    assert quality.features(None) == quality.features("") == [0.0] * len(quality.FEATURES)
    assert len(quality.features("A b!\nc")) == len(quality.FEATURES)


def test_labels_of_absent_documents_take_no_place(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, toxic int")
    present = {r.doc_id for r in docs.where("doc_id is not null").collect()}
    eligible = [i for i in present if zlib.crc32(str(i).encode()) % 5]
    got = {r.d for r in labelled.training_rows(docs, labels, "toxic", 20).collect()}
    assert len(got) == 20 and got <= set(eligible)


def test_remembered_words_stay_with_their_broadcast():
    """Of a model's words only the model is sent, and no module holds what a worker remembers after its broadcast is gone."""
    import gc
    import pickle
    import weakref

    words = toxicity.WordScores({"<ab>": 1.0})
    assert words["ab"] == toxicity.subwords("ab").count("<ab>") / len(toxicity.subwords("ab"))
    sent = pickle.loads(pickle.dumps(words))
    assert len(sent) == 0 and sent.numbers == words.numbers and sent["ab"] == words["ab"]
    held = weakref.ref(sent)
    del sent
    gc.collect()
    assert held() is None and not hasattr(toxicity, "_last")
