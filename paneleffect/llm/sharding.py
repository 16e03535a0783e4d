"""Sharding by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0 to n-1 in the order of (doc_id, content hash); the permutation maps a number to
its place in the shuffled whole, and place p is shard ``p mod shards``, slot ``p div shards``.
Shards' row counts differ by one at most, and shard and slot of any row number can be computed, and
inverted, without the table. The same rows, seed and shard count give the same result whatever
files or partitions they come from.

The row numbers take two passes: rows, without their texts, are dealt to ranges of the order and
stored; ranges are counted, and the counts, one per task, summed up to each range's first number.
The permutation works on 2k bits, the fewest with ``4 ** k >= n``; a number that lands beyond n is
permuted again until it does not (fewer than four steps on average).

Defined cases: a null text counts no bytes, has the CRC of no bytes, and 8 bytes are added as for
every row. Rows equal in doc_id and text are interchangeable; a number of their own, from where they
were read, tells them apart so that no range holds all copies. Null doc_ids come first. Other
columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneleffect.llm import common

SHARDS, SEED, ROUNDS, ROW_BYTES = 24, 20240229, 6, 8
SENT_PARTITIONS = 1_000_000


def _half(x: np.ndarray, key: int) -> np.ndarray:
    return common.mixed(x ^ np.uint64(key))


def _keys(seed: int, rounds: int) -> list[int]:
    return [int(k) for k in common.mixed(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))]


def _bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def permuted(numbers: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """Where the permutation of 0 to n-1 puts each number."""
    return _walk(numbers, n, _keys(seed, rounds), back=False)


def restored(places: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """The inverse of ``permuted``."""
    return _walk(places, n, _keys(seed, rounds), back=True)


def _walk(numbers: np.ndarray, n: int, keys: list[int], back: bool) -> np.ndarray:
    bits = np.uint64(_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for key in reversed(keys) if back else keys:
            if back:
                left, right = right ^ (_half(left, key) & mask), left
            else:
                left, right = right, left ^ (_half(right, key) & mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the global row number of every row, in stored parts."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = common.needed(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("_hash"),
        F.monotonically_increasing_id().alias("_read"),
    )
    order = ["doc_id", "_hash", "_read"]
    # Stored twice: neither the place a row was read at nor the ranges may be computed anew.
    rows = common.stage(rows, "rows-read")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    number = F.monotonically_increasing_id()
    kept = ranged.select("doc_id", "size", "text_crc32", F.shiftright(number, 33).cast("int").alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    kept = common.stage(kept, "rows-in-order")
    counts = kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    places = common.stage(counts.select("part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("place")), "row-places")
    if places.count() <= SENT_PARTITIONS:
        places = F.broadcast(places)
    return kept.join(places, "part").select("doc_id", "size", "text_crc32", (F.col("place") + F.col("row")).alias("number"))


def assign(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is ``rows``) and number."""
    rows = numbered(docs)
    n = rows.count()
    keys = _keys(seed, rounds)
    kind = dict(docs.dtypes)["doc_id"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _walk(batch.column(3).to_numpy(), n, keys, back=False)
            size = len(batch)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(["rows"] * size, pa.string()), pa.array(at % shards, pa.int32()), pa.array(at // shards), pa.nulls(size, pa.int32()), batch.column(3)],
                names=["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "number"],
            )

    schema = f"doc_id {kind}, size long, text_crc32 long, law string, shard int, slot long, grown_shard int, number long"
    return rows.mapInArrow(place, schema)
