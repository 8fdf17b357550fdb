"""Tokenizer, packing, words and model kernels, without Spark where they need none."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from meterline.llm import bpe, packing
from meterline.llm.words import hashed_words, shingles


@pytest.fixture(scope="module")
def reference():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    parts = [*"ab'sSrevltmd  \n\t.,!1²Ⅷé\xa0　\x1c\x1f​漢字\U0001F600́", "'re", "'ll", "'S", " the", "\r\n", "<|endoftext|>"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    return [*made, "", " ", "a" * 500, "é" * 300, " " * 100, "ab" * 3000, "x" * 64, "x" * 65, "\n\n\n a"]


def split_ids(ids, count):
    ends = np.cumsum(count)
    return [ids[e - n:e].tolist() for e, n in zip(ends, count)]


def test_bpe_equals_the_library(reference):
    texts = odd_texts()
    got = split_ids(*bpe.from_ranks(P.path("byte_bpe_50k.tiktoken")).encode(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_bpe_of_every_character(reference):
    texts = [f"a{chr(c)} b{chr(c)}{chr(c)}1" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    got = split_ids(*bpe.from_ranks(P.path("byte_bpe_50k.tiktoken")).encode(texts))
    assert got == [reference.encode_ordinary(t) for t in texts]


def test_bpe_query_round_trip(spark, reference):
    rows = [(1, "The words' end.\n\n ok"), (2, None), (3, ""), (3, "again"), (None, "x"), (4, "naïve " * 4000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, n_tokens string, id int")
    got = bpe.encode_digests(docs, P.path("byte_bpe_50k.tiktoken"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def expected(key, text):
        ids = reference.encode_ordinary(text or "")
        return key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(expected(*r)) for r in rows)
    assert bpe.encode_digests(docs.limit(0), P.path("byte_bpe_50k.tiktoken")).count() == 0


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a ", "word ", "\n", "été "]) for _ in range(rng.randint(0, 900)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "x <|endoftext|> y"), (63, "long " * 9000)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, length string")
    got = packing.pack_documents(docs, P.path("byte_bpe_50k.json")).toPandas()
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == key].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iat[0]
        for start, length, crc in zip(own.start, own.length, own.ids_crc32):
            assert zlib.crc32(ids[start:start + length].tobytes()) == crc
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() <= 1024
    assert got.length.sum() / 1024 > 0.95 * got.sequence_id.nunique()
    assert packing.pack_documents(docs.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_differencing_is_near_equal_and_rises():
    rng = random.Random(1)
    lengths = [rng.randint(1, 256) for _ in range(300)]
    windows = packing.differencing(lengths, 40)
    sums = [sum(lengths[i] for i in w) for w in windows]
    # Each step lays the largest sums of one partial partition on the least of another, so the spread never exceeds the
    # largest item; how far below it ends is not bounded.  Near-equal means a hundredth of a window.
    assert sorted(i for w in windows for i in w) == list(range(300)) and max(sums) - min(sums) <= sum(lengths) / 40 / 100
    for seed in range(20):
        rng = random.Random(seed)
        own = [rng.randint(1, 256) for _ in range(rng.randint(1, 120))]
        sums = [sum(own[i] for i in w) for w in packing.differencing(own, rng.randint(1, 30))]
        assert sum(sums) == sum(own) and max(sums) - min(sums) <= max(own)
    assert len(packing.near_equal_windows([600, 600, 600], 1024)) == 3  # two would hold 1,800 of 2,048, but not whole
    assert packing.near_equal_windows([], 1024) == []


def test_words_and_shingles():
    words, count = hashed_words(["The  cat", "", "the CAT\x0b", "Ä ä", "a\xa0b"])
    assert count.tolist() == [2, 0, 2, 2, 1]
    assert words[0] == words[2] and words[1] == words[3] and words[4] != words[5]
    sets = shingles(*hashed_words(["a b c d e f", "b c d e f", "a b c", "", "a b c d e f a b c d e f"]))
    assert [len(s) for s in sets] == [2, 1, 1, 0, 6]
    assert set(sets[1]) < set(sets[0]) and set(sets[0]) < set(sets[4])


@pytest.mark.parametrize("key", ["null", "5"])
def test_packing_blocks_stay_small_without_ids(spark, key):
    pieces = spark.range(600).selectExpr(f"cast({key} as long) AS doc_id", "0L AS start", "id % 7 + 1 AS length", "id % 3 AS ids_crc32", "id AS doc_tokens")
    rows = packing.pack(pieces, 64, block=20).collect()
    assert sorted(r.doc_tokens for r in rows) == list(range(600))
    assert max(Counter(r.sequence_id // packing.PER_BLOCK for r in rows).values()) <= 60
