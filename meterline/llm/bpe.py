"""Byte-level BPE: ranked merges folded over the byte arrays of distinct words.

A batch of texts is split into words, each distinct word of the batch is encoded once, and the
documents are put together from the words' ids.  Splitting and merging are vectorised: all distinct
words of one length class form a matrix of token ids, and a step merges in each row the adjacent pair
of lowest rank, until no row has a pair in the rank map.  Nothing is shuffled and nothing outlives a batch.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meterline.llm.tables import pieces, record

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Stands between documents; no valid text holds a lone surrogate.
DIVIDER = "\ud800"
#: Longer words are merged one at a time with a heap.
LONGEST = 64
NONE = np.int32(2**31 - 1)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point as the split pattern sees it."""
    import regex

    classes = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            shift = [0x800 if x >= 0xD800 else 0 for x in (m.start(), m.end() - 1)]
            classes[m.start() + shift[0]:m.end() + shift[1]] = kind
    classes[0xD800:0xE000] = OTHER
    classes[ord(DIVIDER)] = END
    return classes


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the split pattern begins a word; *codes* ends with a divider, as does each document."""
    kind = char_classes()[codes]
    start = np.ones(len(codes), bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == END)
    # The last white space before a word stands alone, or belongs to the word if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] < SPACE))
    start[last] = True
    start[last + 1] = codes[last] != 32
    # Contractions: 's 't 'm 'd 're 've 'll, where the apostrophe begins a word.
    quote = np.flatnonzero((codes == 39) & start)
    if len(quote):
        padded = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        for hit, width in ((quote[one], 1), (quote[two], 2)):
            start[hit + 1] = False
            start[hit + 1 + width] = True
    return start


class ByteBPE:
    """Encoder for a vocabulary of byte strings whose id is also their merge rank."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces = {i: b for b, i in ranks.items()}
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = {}
        for word, i in ranks.items():
            for cut in range(1, len(word)):
                left, right = ranks.get(word[:cut]), ranks.get(word[cut:])
                if left is not None and right is not None:
                    pairs[left << 16 | right] = i
        self._place(np.fromiter(pairs, np.uint32, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _place(self, keys: np.ndarray, values: np.ndarray) -> None:
        """The rank map as an open-addressed table that is probed for whole arrays."""
        self.bits = max(10, int(len(keys) * 6).bit_length())
        self.keys, self.values = np.full(1 << self.bits, 2**32 - 1, np.uint32), np.full(1 << self.bits, NONE, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            free = self.keys[slot[left]] == 2**32 - 1
            mine = left[free]
            self.keys[slot[mine]] = keys[mine]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435769)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id, which is the rank, of each pair; NONE where the pair is no token."""
        keys = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        open_ = np.flatnonzero((found != keys) & (found != 2**32 - 1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != 2**32 - 1)]
        return out

    def encode_words(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, ids per word) for words data[start:start + size]."""
        count = np.ones(len(start), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, LONGEST):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for part in (rows[i:i + 8192] for i in range(0, len(rows), 8192)):
                ids, n = self._fold(data, start[part], size[part], high)
                found.append((part, ids))
                count[part] = n
        for row in np.flatnonzero(size > LONGEST):
            ids = np.array(self._heap(data[start[row]:start[row] + size[row]].tobytes()), np.int32)
            found.append((np.array([row]), ids[None, :]))
            count[row] = len(ids)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(begin[-1], np.int32)
        for part, ids in found:
            valid = np.arange(ids.shape[1]) < count[part][:, None]
            out[(begin[part][:, None] + np.arange(ids.shape[1]))[valid]] = ids[valid]
        return out, count

    def _fold(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(start[:, None] + np.arange(width), len(data) - 1)
        ids = self.single[data[at]]
        n = size.astype(np.int64)
        if width == 1:
            return ids, n
        rank = self.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(-1, width - 1)
        rank[np.arange(1, width) >= n[:, None]] = NONE
        out = ids.copy()
        row, col = np.arange(len(ids)), np.arange(width - 1)
        n_out = n.copy()
        while len(row):
            best = rank.argmin(1)
            low = rank[np.arange(len(row)), best]
            going = low != NONE
            if not going.all():
                done = ~going
                out[row[done]] = ids[done]
                n_out[row[done]] = n[done]
                row, ids, rank, n, best, low = row[going], ids[going], rank[going], n[going], best[going], low[going]
                if not len(row):
                    break
            i = np.arange(len(row))
            ids[i, best] = low
            n = n - 1
            behind = col[None, :] >= best[:, None]
            ids[:, 1:][behind] = np.concatenate([ids[:, 2:], ids[:, -1:]], 1)[behind]
            shifted = np.concatenate([rank[:, 1:], np.full((len(row), 1), NONE, np.int32)], 1)
            rank = np.where(col[None, :] >= best[:, None], shifted, rank)
            right = best + 1 < n
            rank[i[right], best[right]] = self.merged(low[right], ids[i[right], best[right] + 1])
            rank[i[~right & (best < width - 1)], best[~right & (best < width - 1)]] = NONE
            left = best > 0
            rank[i[left], best[left] - 1] = self.merged(ids[i[left], best[left] - 1], low[left])
        return out, n_out

    def _heap(self, word: bytes) -> list[int]:
        """One long word: neighbours in a linked list, pairs in a heap by rank and place."""
        ids = [int(self.single[b]) for b in word]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        names = self.pieces

        def push(i: int) -> None:
            if i >= 0 and after[i] < len(ids):
                rank = self.ranks.get(names[ids[i]] + names[ids[after[i]]])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[after[i]]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(len(ids)):
            push(i)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            push(i)
            push(before[i])
        return [x for x in ids if x >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, ids per text)."""
        joined = DIVIDER.join([*texts, ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        divider = codes == ord(DIVIDER)
        width[divider] = 0
        data = np.frombuffer("".join(texts).encode() + bytes(24), np.uint8)
        place = np.cumsum(width, dtype=np.int64) - width
        at = np.flatnonzero(word_starts(codes))
        text_of = np.cumsum(divider[at])
        keep = ~divider[at]
        start, text_of = place[at[keep]], text_of[keep]
        total = int(width.sum(dtype=np.int64))
        # A word ends where the next one begins; dividers take no bytes.
        size = np.diff(np.append(start, total))
        del codes, place, width
        inverse, first = distinct_words(data, start, size)
        ids, count = self.encode_words(data, start[first], size[first])
        begin = np.cumsum(count) - count
        per_word = count[inverse]
        out_at = np.cumsum(per_word) - per_word
        source = np.repeat(begin[inverse] - out_at, per_word) + np.arange(int(per_word.sum()))
        return ids[source], np.bincount(text_of, per_word, len(texts)).astype(np.int64)


def distinct_words(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word of each word, a word's place for each distinct word); compared byte by byte."""
    n = len(start)
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    low = eight[start] & masks[np.minimum(size, 8)]
    high = eight[np.minimum(start + 8, len(eight) - 1)] & masks[np.clip(size - 8, 0, 8)]
    owner = np.full(n, -1, np.int64)
    long = np.flatnonzero(size > 16)
    seen: dict[bytes, int] = {}
    for i in long.tolist():
        owner[i] = seen.setdefault(data[start[i]:start[i] + size[i]].tobytes(), i)
    left = np.flatnonzero(size <= 16)
    bits = max(10, int(n).bit_length() + 1)
    slots = np.zeros(1 << bits, np.int64)
    turn = 0
    mix = low * np.uint64(0x9E3779B97F4A7C15) ^ (high + size.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
    while len(left):
        turn += 1
        h = mix[left] * np.uint64(2 * turn + 1) ^ (mix[left] >> np.uint64(29))
        h = (h * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - bits)).astype(np.int64)
        slots[h] = left
        other = slots[h]
        same = (low[other] == low[left]) & (high[other] == high[left]) & (size[other] == size[left])
        owner[left[same]] = other[same]
        left = left[~same]
    first = np.flatnonzero(owner == np.arange(n))
    number = np.empty(n, np.int64)
    number[first] = np.arange(len(first))
    return number[owner], first


@lru_cache(4)
def from_ranks(path: str) -> ByteBPE:
    """From a rank file: a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})


def encode_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: (id, n_tokens, ids_sha256, decoded_sha256).

    The digests are of the decimal ids joined by a space and of the decoded bytes.  A null text is an
    empty one: no tokens, digests of the empty string.  Repeated rows give repeated results; other
    columns of *docs* are not read.  *path* must be readable on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_ranks(path)
        decimal = [str(i) for i in range(1 << 16)]
        piece = [bpe.pieces.get(i, b"") for i in range(1 << 16)]
        for rows, texts in pieces(batches):
            ids, count = bpe.encode(texts)
            sha, back, end = [], [], np.cumsum(count)
            for a, b in zip((end - count).tolist(), end.tolist()):
                own = ids[a:b].tolist()
                sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join(map(piece.__getitem__, own))).hexdigest())
            yield record(id=rows.column("id"), n_tokens=count, ids_sha256=sha, decoded_sha256=back)

    from pyspark.sql import functions as F

    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumnRenamed("id", id_column)
