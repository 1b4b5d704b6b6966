"""Piece encoding and token counts against the libraries."""

import random

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from vellum.llm import pieces, token_counts

MODEL, JSON = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, id string, n_tokens string"


def texts(seed):
    rnd = random.Random(seed)
    bits = ["a", "the", "ing", " ", "  ", "    ", "\n", "\t", "é", "日本", "ß", "0", "12", ".", "'s", "'S", "▁", "😀", "\xa0", "　", "ﬁ", "aaaa", "<|endoftext|>", "<s>", "՘", " ", "\x85", "\x1f", "Ⅷ", "ँ"]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(800)] + ["", "word " * 40_000, "x" * 3000, "\U00010940\U00010941 a"]


def rows(seed):
    return [(i, t, "x", "y") for i, t in enumerate(texts(seed))] + [(9000, None, "", ""), (None, "a b", "", ""), (3, "again", "", ""), (3, "again", "", "")]


def test_pieces_match_the_library_and_decode(spark):
    data = rows(1)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = pieces.encode_documents(spark.createDataFrame(data, SCHEMA), MODEL).collect()
    want = sorted((d if d is not None else -1, library.encode(t or "")) for d, t, *_ in data)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.pieces)) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert all(by[d].decoded == (t or "").replace("▁", " ") for d, t, *_ in data if d is not None and d != 3)
    digests = pieces.encode_digests(spark.createDataFrame(data, SCHEMA), MODEL).collect()
    assert len(digests) == len(data) and all(r.round_trip for r in digests)
    assert pieces.encode_digests(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_unigram_scores_are_maximal():
    m = pieces.Pieces(MODEL, unigram=True)
    rnd = random.Random(2)

    def best(word):
        score = [0.0] + [float("-inf")] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - m.longest), j):
                k = m.ids.get(word[i:j])
                worth = m.score[k] if k is not None else -1e9 if j - i == 1 else float("-inf")
                score[j] = max(score[j], score[i] + worth)
        return score[-1]

    words = ["▁" + "".join(rnd.choice("thereing") for _ in range(rnd.randint(1, 12))) for _ in range(200)]
    import numpy as np

    for word, ids in m.segment(words).items():
        assert sum(m.score[i] for i in np.frombuffer(ids, np.int32)) == best(word)


def test_counts_match_the_library(spark):
    data = rows(3)
    library = Tokenizer.from_file(JSON)
    got = token_counts.token_counts(spark.createDataFrame(data, SCHEMA), JSON, limit=50).collect()
    key = lambda d: d if d is not None else -1
    want = sorted((key(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for d, t, *_ in data)
    assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_a_full_worker_table_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "WORKER_ENTRIES", 5)
    counts = token_counts.Counts(JSON)
    library = Tokenizer.from_file(JSON)
    for t in texts(4)[:300]:
        assert counts.count(t, {"the": 1}) == len(library.encode(t, add_special_tokens=False).ids)
