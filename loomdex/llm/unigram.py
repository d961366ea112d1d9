"""Unigram segmentation with the pieces and scores of a SentencePiece model file.

A text is prefixed by a space if the model says so, spaces are U+2581, and the best
segmentation is the one of the largest sum of scores. Ties and unknown characters
follow the library's Viterbi: at each character, the piece that starts first wins a tie; a
character that is no piece is unknown, at 10 below the least score, and becomes its
UTF-8 bytes where the model has pieces for them. Scores are integers (multiplied by a
power of two where a model has fractions), so sums are exact at any length.

No piece has a space after another character, and none of some control characters at all, so
segmentation never reaches across such places (cuts): what stands between two of them
is segmented once and remembered.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field

import ahocorasick
import numpy as np

from loomdex.llm.words import Remembered

SPACE = "▁"
#: Texts between cuts whose segmentation a worker remembers in each of two generations, and how long they may be.
CACHE_WORDS, CACHE_CHARS = 200_000, 64

_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = 1, 2, 3, 4, 5, 6


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes):
    """(number, value) of a protocol buffer message; bytes, ints and float bytes as they are."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        elif kind == 2:
            size, at = _varint(raw, at)
            value, at = raw[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Vocabulary:
    """Pieces of a model: (text, integer score, id) of those that match text, and the special ids."""

    pieces: list[tuple[str, int, int]]
    texts: list[str]
    unknown: int
    unknown_score: int
    bytes_: list[int] | None
    dummy_prefix: bool
    controls: frozenset[int] = field(default_factory=frozenset)

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)


def read_vocabulary(model: bytes) -> Vocabulary:
    """The vocabulary of a serialized SentencePiece model, of any model type."""
    found, dummy = [], True
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            found.append((piece[1].decode(), score, piece.get(3, _NORMAL)))
        elif number == 3:
            dummy = bool(dict(_fields(value)).get(3, 1))
    scores = [s for _, s, k in found if k in (_NORMAL, _USER)]
    scale = 1 if all(s == int(s) for s in scores) else 1 << 24
    texts, pieces, raw, unknown, controls = [], [], {}, 0, set()
    for i, (text, score, kind) in enumerate(found):
        texts.append(text.replace(SPACE, " "))
        if kind in (_NORMAL, _USER):
            pieces.append((text.replace(SPACE, " "), round(score * scale), i))
        elif kind == _BYTE:
            raw[int(text[3:5], 16)] = i
        elif kind == _UNKNOWN:
            unknown = i
        elif kind == _CONTROL:
            controls.add(i)
    least = min((s for _, s, _ in pieces), default=0)
    return Vocabulary(
        pieces, texts, unknown, least - 10 * scale, [raw[b] for b in range(256)] if len(raw) == 256 else None, dummy, frozenset(controls)
    )


class Segmenter:
    """Viterbi over texts whose spaces are plain; positions are characters."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        for text, score, i in vocabulary.pieces:
            self.automaton.add_word(text, (len(text), score, i))
        if vocabulary.pieces:
            self.automaton.make_automaton()
        self.single = {p for p, _, _ in vocabulary.pieces if len(p) == 1}
        inner = any(" " in p.lstrip(" ") for p, _, _ in vocabulary.pieces)
        used = set().union(*(p for p, _, _ in vocabulary.pieces)) if vocabulary.pieces else set()
        alone = "".join(c for c in "\n\r\t\v\f" if c not in used)
        stops = re.escape(alone)
        #: Texts between cuts; the whole text if a piece may reach over a space.
        self.between = re.compile(rf"[{stops}]| *[^ {stops}]+| +" if alone else r" *[^ ]+| +") if not inner else re.compile(r"(?s).+")
        self.alone, self.cuts = frozenset(alone), not inner
        self.counts = Remembered(self.count_word, CACHE_WORDS, CACHE_CHARS)
        self.ids = Remembered(self._segment, CACHE_WORDS, CACHE_CHARS)
        value = {i: bytes([b]) for b, i in enumerate(vocabulary.bytes_ or [])}
        texts = [value.get(i, b"" if i in vocabulary.controls else t.encode()) for i, t in enumerate(vocabulary.texts)]
        if texts:
            texts[vocabulary.unknown] = " ⁇ ".encode()
        self.raw = np.array([*texts, None], object)[:-1]

    def is_cut(self, text: str, at: int) -> bool:
        """No piece reaches across position ``at``, 0 < at < len(text)."""
        a, b = text[at - 1], text[at]
        return a in self.alone or b in self.alone or (self.cuts and a != " " and b == " ")

    def forward(self, text: str, start: dict[int, int] | None = None, after: int = 0):
        """(best score, start of the last piece, its id) at each position; None where unreachable.

        ``start`` gives scores of positions at or before ``after``, from which pieces may
        leave; positions after it are computed.
        """
        n = len(text)
        best: list[int | None] = [None] * (n + 1)
        back, piece = [-1] * (n + 1), [-1] * (n + 1)
        for at, score in (start or {0: 0}).items():
            best[at] = score
        unknown, single = self.vocabulary.unknown_score, self.single
        matches: list[list] = [[] for _ in range(n + 1)]
        if self.vocabulary.pieces:
            for end, match in self.automaton.iter(text):  # of one end, the longest first
                matches[end + 1].append(match)
        for end in range(after + 1, n + 1):
            top, where, which = None, -1, -1
            for size, score, i in matches[end]:
                base = best[end - size]
                if base is not None and (top is None or base + score > top):
                    top, where, which = base + score, end - size, i
            base = best[end - 1]
            if base is not None and text[end - 1] not in single and (top is None or base + unknown > top):
                top, where, which = base + unknown, end - 1, -1
            best[end], back[end], piece[end] = top, where, which
        return best, back, piece

    def path(self, text: str, back: list[int], piece: list[int], end: int, until: int = 0) -> tuple[int, list[tuple[int, int]]]:
        """(position reached, (id or -1, end) of each piece) backwards from ``end`` to ``until`` or before."""
        out = []
        while end > until:
            out.append((piece[end], end))
            end = back[end]
        return end, out[::-1]

    def ids_of(self, text: str, steps: list[tuple[int, int]]) -> list[int]:
        v, out = self.vocabulary, []
        for i, end in steps:
            if i >= 0:
                out.append(i)
            elif v.bytes_:
                out.extend(v.bytes_[b] for b in text[end - 1].encode("utf-8", "surrogatepass"))
            elif not out or out[-1] != v.unknown:
                out.append(v.unknown)
        return out

    def _segment(self, word: str) -> bytes:
        """Ids of a text between cuts, as packed 32-bit integers: the recursion of forward() in one pass over the matches."""
        n = len(word)
        best: list[int | None] = [0] + [None] * n
        back, piece = [-1] * (n + 1), [-1] * (n + 1)
        single, unknown_score = self.single, self.vocabulary.unknown_score
        done = 0
        for at, (size, score, i) in self.automaton.iter(word) if self.vocabulary.pieces else ():
            end = at + 1
            while done < end - 1:  # all matches that end there are in
                done += 1
                base = best[done - 1]
                if base is not None and word[done - 1] not in single and (best[done] is None or base + unknown_score > best[done]):
                    best[done], back[done] = base + unknown_score, done - 1
                    piece[done] = -1
            base = best[end - size]
            if base is not None and (best[end] is None or base + score > best[end]):
                best[end], back[end], piece[end] = base + score, end - size, i
        while done < n:
            done += 1
            base = best[done - 1]
            if base is not None and word[done - 1] not in single and (best[done] is None or base + unknown_score > best[done]):
                best[done], back[done] = base + unknown_score, done - 1
                piece[done] = -1
        ids = self.ids_of(word, self.path(word, back, piece, n)[1])
        return array("i", ids).tobytes()

    def word_ids(self, word: str) -> array:
        return array("i", self.ids[word])

    def prefixed(self, text: str | None) -> str:
        text = (text or "").replace(SPACE, " ")
        return " " + text if text and self.vocabulary.dummy_prefix else text

    def encode_packed(self, text: str | None) -> bytes:
        """Ids of a whole text as packed 32-bit integers; none for empty or null."""
        return b"".join(map(self.ids.__getitem__, self.between.findall(self.prefixed(text))))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.encode_packed(text)).tolist()

    def count_word(self, word: str) -> int:
        """Number of pieces: the dynamic program carries score and count only, no path."""
        n = len(word)
        best: list[int | None] = [0] + [None] * n
        count = [0] * (n + 1)
        v, single = self.vocabulary, self.single
        width = [len(c.encode("utf-8", "surrogatepass")) if v.bytes_ else 1 for c in word]
        done = 0

        def unknown(end: int) -> None:
            base = best[end - 1]
            if base is not None and word[end - 1] not in single and (best[end] is None or base + v.unknown_score > best[end]):
                best[end], count[end] = base + v.unknown_score, count[end - 1] + width[end - 1]

        for at, (size, score, _) in self.automaton.iter(word) if v.pieces else ():
            end = at + 1
            while done < end - 1:  # all matches of these ends are in
                done += 1
                unknown(done)
            base = best[end - size]
            if base is not None and (best[end] is None or base + score > best[end]):
                best[end], count[end] = base + score, count[end - size] + 1
        while done < n:
            done += 1
            unknown(done)
        return count[n]

    def count(self, text: str | None) -> int:
        """Number of pieces of a whole text."""
        if not self.vocabulary.bytes_:
            return len(self.encode(text))
        return sum(map(self.counts.__getitem__, self.between.findall(self.prefixed(text))))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces vanish, byte pieces are joined to UTF-8, the dummy prefix goes."""
        raw = b"".join(self.raw[np.asarray(ids, np.int64)].tolist())
        text = raw.decode("utf-8", "replace")
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


_loaded: dict[int, tuple[bytes, Segmenter]] = {}


def segmenter(model: bytes) -> Segmenter:
    """A worker's segmenter of a model, kept for its next tasks."""
    found = _loaded.get(len(model))
    if found is None or found[0] != model:
        found = _loaded[len(model)] = (model, Segmenter(read_vocabulary(model)))
    return found[1]
