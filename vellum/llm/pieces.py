"""SentencePiece encoding and decoding by a Viterbi pass that shares prefixes.

A text becomes marked words: white space turns to the mark U+2581, one mark goes in front, and the
text is cut before each run of marks (no piece of the model has a mark after another character, which
is checked). The distinct marked words of an Arrow batch are sorted, which lays them out as a trie in
depth-first order; the forward state of each prefix is kept on a stack, and a word starts from the
states of the prefix that it shares with the word before it.

The forward state of a prefix is the last piece of its best segmentation. In a BPE model the best
segmentation is the one that merging by priority gives. A segmentation is that one exactly if each
two neighbours, encoded together, stay as they are; and each prefix has one such segmentation. So the
forward step looks for the piece that may follow the state where it starts. In a unigram model the
forward step maximises the sum of the scores instead. Characters outside the vocabulary become byte
pieces. No text is cut; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

MARK = "▁"
UNITS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Entries of a worker's cache of encoded words, and of pairs of pieces; the cache is emptied when full.
CACHE_WORDS, CACHE_PAIRS = 400_000, 1_000_000


class Pieces:
    """The vocabulary of a model file and the two directions."""

    def __init__(self, path: str, unigram: bool = False):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.unigram = unigram
        self.unknown = model.unk_id()
        self.byte_ids = {}
        self.ids: dict[str, int] = {}
        self.score: list[float] = [0.0] * n
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            piece, self.score[i] = model.id_to_piece(i), model.get_score(i)
            if model.is_byte(i):
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.byte_ids[self.raw[i][0]] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.ids[piece] = i
                self.raw[i] = piece.replace(MARK, " ").encode()
        self.raw[self.unknown] = " ⁇ ".encode()
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.fromiter(map(len, self.raw), np.int64, n)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece spans two marked words; they cannot be encoded apart")
        self.longest = max(map(len, self.ids), default=1)
        lengths: dict[str, set[int]] = {}
        for p in self.ids:
            if len(p) > 1:
                lengths.setdefault(p[-2:], {1}).add(len(p))
            if len(p) > 2:
                lengths.setdefault(p[-3:], {1, *[2] * (p[-2:] in self.ids)}).add(len(p))
        #: The lengths, falling, of the pieces that end in the given three (or, where there are none, two) characters.
        self.ending = {end: tuple(sorted((k for k in n if k != 2 or end[-2:] in self.ids), reverse=True)) for end, n in lengths.items()}
        self.piece = {i: p for p, i in self.ids.items()}
        self.whole: dict[str, bool] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Merge by priority, the leftmost first among equals; for short strings."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def starts(self, piece: str) -> bool:
        """Whether a word's segmentation can begin with the piece."""
        known = self.whole.get(piece)
        if known is None:
            known = self.whole[piece] = len(piece) == 1 or self.merged(piece) == [piece]
        return known

    def follows(self, left: int, right: int) -> bool:
        """Whether the two pieces, encoded together, stay as they are."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        a, b = self.piece[left], self.piece[right]
        known = self.pairs[left * 65536 + right] = self.merged(a + b) == [a, b]
        return known

    def forward(self, word: str, shared: int, last: list[int], piece: list[int], best: list[float]) -> None:
        """Extend the states of word[:shared] to the whole word.

        last[d] and piece[d]: length and id (-1: not in the vocabulary) of the piece that ends at d; best[d]:
        the score so far, in a unigram model.
        """
        del last[shared + 1 :], piece[shared + 1 :], best[shared + 1 :]
        ids, ending, pairs = self.ids, self.ending, self.pairs
        if self.unigram:
            for d in range(shared + 1, len(word) + 1):
                score, length, found = best[d - 1] - 1e9, 1, -1  # an unknown character
                for k in range(1, min(self.longest, d) + 1):
                    i = ids.get(word[d - k : d])
                    if i is not None and best[d - k] + self.score[i] > score:
                        score, length, found = best[d - k] + self.score[i], k, i
                last.append(length)
                piece.append(found)
                best.append(score)
            return
        for d in range(shared + 1, len(word) + 1):
            k, i = 1, -1
            for k in ending.get(word[d - 3 : d] if d > 2 else "") or ending.get(word[d - 2 : d] if d > 1 else "", (1,)):
                i = ids.get(word[d - k : d], -1) if k <= d else -1
                if k == 1:
                    break  # the last resort always fits
                if i < 0:
                    continue
                if k == d:
                    if self.starts(word[:d]):
                        break
                    continue
                left = piece[d - k]
                if left < 0:
                    break
                fits = pairs.get(left * 65536 + i)
                if self.follows(left, i) if fits is None else fits:
                    break
            last.append(k)
            piece.append(i)

    def segment(self, words: list[str]) -> dict[str, bytes]:
        """Piece ids of distinct words as 32-bit integers, walking their trie depth-first."""
        out, before = {}, ""
        last, piece, best = [0], [-1], [0.0]
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            self.forward(word, shared, last, piece, best)
            found, d = [], len(word)
            while d:
                if piece[d] >= 0:
                    found.append(piece[d])
                else:
                    found += [self.byte_ids.get(b, self.unknown) for b in reversed(word[d - 1].encode())]
                d -= last[d]
            found.reverse()
            out[word] = array("i", found).tobytes()
            before = word
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text, as the model's own library gives them for an identity normaliser."""
        units = [UNITS.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        words, distinct = self.words, set(chain.from_iterable(units))
        words.update(self.segment([u for u in distinct if u not in words]))
        near = {u: words[u] for u in distinct}
        return [np.frombuffer(b"".join(map(near.__getitem__, us)), np.int32) for us in units]

    def decode(self, ids: np.ndarray) -> str:
        """The text again: byte pieces are joined before they are read as UTF-8; the first mark goes."""
        sizes = self.raw_size[ids]
        total = np.cumsum(sizes)
        at = np.repeat(self.raw_start[ids] - (total - sizes), sizes) + np.arange(total[-1] if len(ids) else 0)
        return self.raw_bytes[at].tobytes().removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str, unigram: bool = False) -> Pieces:
    return Pieces(path, unigram)


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", unigram: bool = False) -> DataFrame:
    """(id, pieces array<int>, n_pieces long, decoded string) of every document.

    A null text counts as empty: no piece, decoded empty. Repeated rows give repeated rows; other
    columns are left out. A text's marks U+2581 decode as spaces, as in the library.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model, unigram)
        for b in batches:
            ids = m.encode([t or "" for t in b.column(1).to_pylist()])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.array(sizes), pa.array([m.decode(x) for x in ids], pa.string())], ["id", "pieces", "n_pieces", "decoded"])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {kind}, pieces array<int>, n_pieces long, decoded string")
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model: str, unigram: bool = False) -> DataFrame:
    """doc_id, n_words, n_pieces, pieces_sha256 (ids as little-endian 32-bit), decoded_sha256, round_trip of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model, unigram)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            ids = m.encode(texts)
            back = [m.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(t.split(" ")) if t else 0 for t in texts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<i4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                    pa.array([t.replace(MARK, " ") == u for t, u in zip(texts, back, strict=True)], pa.bool_()),
                ],
                ["doc_id", "n_words", "n_pieces", "pieces_sha256", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_pieces long, pieces_sha256 string, decoded_sha256 string, round_trip boolean")


def with_pieces(docs: DataFrame, model: str) -> DataFrame:
    """docs with pieces array<int>, n_pieces long and round_trip: whether decoding gives the text again, marks read as spaces.

    Columns of these three names are replaced; all others stay, whatever their names and types. A null text
    has no pieces.
    """
    fields = [f for f in docs.schema.fields if f.name not in ("pieces", "n_pieces", "round_trip")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            ids = m.encode(texts)
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            same = pa.array([t.replace(MARK, " ") == m.decode(x) for t, x in zip(texts, ids, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(offsets, flat), pa.array(sizes), same], [*b.schema.names, "pieces", "n_pieces", "round_trip"])

    schema = T.StructType([*fields, T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("round_trip", T.BooleanType())])
    return docs.select([f.name for f in fields]).mapInArrow(run, schema)
