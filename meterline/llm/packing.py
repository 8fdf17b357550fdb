"""Packing token sequences into windows by multiway Karmarkar-Karp differencing.

Every document is cut into full windows, which need no partner, and a remainder.  Remainders, cut to
at most a quarter of a window, are dealt into blocks; in a block the differencing merges partial
partitions with opposing imbalances until one partition with near-equal windows is left.  The number
of windows is the least that could hold the block, and rises by one while a window is over capacity.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm.bpe import ByteBPE
from meterline.llm.tables import pieces, record
from meterline.session import settle

#: Remainder pieces in a block on average; a block's windows are chosen together by one task.
BLOCK = 512
#: Width of the number range that a block may give its sequences.
PER_BLOCK = 1 << 24


@lru_cache(4)
def from_tokenizer(path: str) -> tuple[ByteBPE, object, tuple[str, ...]]:
    """(encoder, tokenizer, special strings) of a tokenizer file with a byte-level vocabulary."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    tokenizer = Tokenizer.from_file(path)
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    # A vocabulary file writes each byte as one printable character; the library's own alphabet, in
    # the order of its definition: printable bytes stand for themselves, the rest follow from U+0100 on.
    plain = [b for b in range(256) if chr(b) in ByteLevel.alphabet() and b < 256]
    byte_of = {chr(b): b for b in plain}
    byte_of.update({chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)})
    ranks = {bytes(byte_of[c] for c in word): i for word, i in tokenizer.get_vocab(False).items() if word not in special}
    # Ids serve as merge ranks only if single bytes aside they were given in merge order; tests hold both encoders together.
    return ByteBPE(ranks), tokenizer, tuple(special)


def tokenized_pieces(docs: DataFrame, path: str, window: int = 1024, part: int = 256, closing: int = 0,
                     id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): full windows, and the remainder in parts of at most *part*.

    A document's ids are those of its text and *closing*; a null text is empty, so it has one id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, tokenizer, special = from_tokenizer(path)
        for rows, texts in pieces(batches):
            # Texts that spell a special token go through the tokenizer, which gives it its own id.
            odd = [i for i, t in enumerate(texts) if any(s in t for s in special)]
            ids, count = bpe.encode(["" if i in set(odd) else t for i, t in enumerate(texts)] if odd else texts)
            own = {i: np.array(e.ids, np.int32) for i, e in zip(odd, tokenizer.encode_batch([texts[i] for i in odd], add_special_tokens=False))} if odd else {}
            ends = np.cumsum(count)
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, (row, a, b) in enumerate(zip(rows.column("id").to_pylist(), (ends - count).tolist(), ends.tolist())):
                all_ids = np.append(own.get(i, ids[a:b]), closing).astype("<u4")
                total = len(all_ids)
                full = total // window * window
                cuts = [*range(0, full, window), *range(full, total, part), total]
                for start, stop in zip(cuts, cuts[1:]):
                    for column, value in zip(out, (row, start, stop - start, zlib.crc32(all_ids[start:stop].tobytes()), total)):
                        column.append(value)
            yield record(id=pa.array(out[0], pa.int64()), start=out[1], length=out[2], ids_crc32=out[3], doc_tokens=out[4])

    found = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, start long, length long, ids_crc32 long, doc_tokens long")
    return found.withColumnRenamed("id", id_column)


def differencing(lengths: list[int], windows: int) -> list[list[int]]:
    """Items of each window: Karmarkar-Karp differencing of *lengths* into *windows* subsets."""
    # A partial partition: sums falling, the items of each; sorted in a heap by its imbalance.
    heap = []
    for i, x in enumerate(lengths):
        heap.append((-x, i, np.array([x] + [0] * (windows - 1)), [[i]] + [[]] * (windows - 1)))
    heapq.heapify(heap)
    serial = len(lengths)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        sums = a + b[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        joined = [x + y if x and y else x or y for x, y in zip(a_items, reversed(b_items))]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), serial, sums, [joined[k] for k in order.tolist()]))
        serial += 1
    return heap[0][3]


def near_equal_windows(lengths: list[int], capacity: int) -> list[list[int]]:
    """As few windows as the differencing can fill without going over *capacity*."""
    if not lengths:
        return []
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        found = differencing(lengths, windows)
        if all(sum(lengths[i] for i in items) <= capacity for items in found):
            return [items for items in found if items]
        windows += 1


def pack(pieces_table: DataFrame, capacity: int = 1024, block: int = BLOCK, id_column: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of length 1 to *capacity*.

    A full piece is a sequence of its own.  The others are dealt by a hash of (id, start), their content
    and a number written with each row into blocks of about *block* pieces, so neither a long document nor
    a hot source nor rows without an id make a large block.  Rows that repeat an id are packed as pieces of
    their own.  An empty table gives an empty one.
    """
    kept = pieces_table.columns
    stored = settle(pieces_table.withColumn("__salt", F.monotonically_increasing_id()), "pieces")
    small = stored.where(F.col("length") < capacity).count()
    blocks = max(1, -(-small // block))
    dealt = stored.withColumn("block", F.pmod(F.xxhash64(id_column, "start", "ids_crc32", "__salt"), F.lit(blocks)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([id_column, "start", "ids_crc32"], ignore_index=True)
        full = np.flatnonzero(rows.length.to_numpy() >= capacity)
        rest = np.flatnonzero(rows.length.to_numpy() < capacity)
        lengths = rows.length.to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        first = int(rows.block.iat[0]) * PER_BLOCK
        sequence[full] = first + np.arange(len(full))
        for n, items in enumerate(near_equal_windows(lengths[rest].tolist(), capacity), first + len(full)):
            own = rest[sorted(items)]
            sequence[own] = n
            offset[own] = np.cumsum(lengths[own]) - lengths[own]
        return rows[kept].assign(sequence_id=sequence, offset=offset)

    schema = stored.drop("__salt").withColumn("sequence_id", F.lit(0).cast("long")).withColumn("offset", F.lit(0).cast("long")).schema
    return dealt.groupBy("block").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, closing: int = 0, id_column: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """Tokenize, cut and pack: one row per piece."""
    cut = tokenized_pieces(docs, path, capacity, max(1, capacity // 4), closing, id_column, text)
    return pack(cut, capacity, id_column=id_column)
