"""Packing: concatenate all documents' token ids and cut the row of ids into fixed windows.

Pass one tokenises every text, ends it with ``end_id`` and stores the ids with the running total of
ids inside their task's partition. The partitions' totals, one number per task, are summed up to
each partition's place in the whole. Pass two adds that to the stored running total, which gives
every document its place in the whole row of ids, and cuts it at multiples of ``window``: a document
that crosses windows leaves one piece, a boundary record, in each. Nothing but the totals is
shuffled, and only the last window is not full.

Ids are those of ``tokenizers`` for the vocabulary file; they are computed with the same vocabulary
as ranks, which is several times faster (tests compare both). The vocabulary's own special token
is recognised in texts, as that library does.

Defined cases: a null text is empty and leaves the end id only, as does an empty text. Repeated rows
and null doc_ids are packed like others. Other columns are ignored. No documents give no pieces.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from paneleffect.llm import common

WINDOW, END_ID = 1024, 0
SPECIAL = {"<|endoftext|>": 50256}
#: More partitions than this are joined by a shuffle, not sent to every task.
SENT_PARTITIONS = 1_000_000


def vocabulary() -> str:
    """The installed vocabulary, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str) -> tiktoken.Encoding:
    import public_tokenizers

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokens(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Stored: doc_id, part, before (ids before the document in its part), n, ids (16 bits each)."""
    kind = dict(docs.dtypes)["doc_id"]
    path = path or vocabulary()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, before = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype="<u2").tobytes()
        for batch in batches:
            ids, sizes = [], np.empty(len(batch), dtype=np.int64)
            for k, text in enumerate(batch.column(1)):
                found = coder.encode_to_numpy(text.as_py() or "", allowed_special="all").astype("<u2")
                ids.append(found.tobytes() + end)
                sizes[k] = len(found) + 1
            starts = before + np.cumsum(sizes) - sizes
            before += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(batch), part), pa.int32()), pa.array(starts), pa.array(sizes), pa.array(ids, pa.large_binary()).cast(pa.binary())],
                names=["doc_id", "part", "before", "n", "ids"],
            )

    schema = f"doc_id {kind}, part int, before long, n long, ids binary"
    return common.stage(common.needed(docs, "doc_id", "text").mapInArrow(tokenise, schema), "tokens")


def placed(stored: DataFrame) -> DataFrame:
    """``stored`` with ``at``, the number of ids before each document in the whole row of ids."""
    totals = stored.groupBy("part").agg(F.sum("n").alias("total"))
    # One row per task of pass one.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("place"))
    places = common.stage(places, "token-places")
    if places.count() <= SENT_PARTITIONS:
        places = F.broadcast(places)
    return stored.join(places, "part").select("doc_id", "n", "ids", (F.col("place") + F.col("before")).alias("at"))


def pieces(docs: DataFrame, window: int = WINDOW, path: str | None = None, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the
    ids themselves on request."""
    kind = dict(docs.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, at = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            first = at // window
            many = (at + n - 1) // window - first + 1
            row = np.repeat(np.arange(len(n)), many)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            begin = np.maximum(at[row], sequence * window)
            length = np.minimum((at + n)[row], (sequence + 1) * window) - begin
            start = begin - at[row]
            wide = [np.frombuffer(ids.as_buffer(), dtype="<u2").astype("<u4") for ids in batch.column(2)]
            own = [wide[r][s : s + k] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            arrays = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in own], pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(begin - sequence * window)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for x in own], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    stored = placed(tokens(docs, path, end_id))
    return stored.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def sequences(cut: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """sequence_id, ids (exactly ``window``, padded at the end of the last one) and doc_ids, from
    pieces with ids; a group is one window."""
    one = cut.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("p"))
    ids = F.flatten(F.col("p.ids"))
    filled = F.concat(ids, F.array_repeat(F.lit(pad_id), F.lit(window) - F.size(ids)))
    return one.select("sequence_id", F.when(F.size(ids) < window, filled).otherwise(ids).alias("ids"), F.col("p.doc_id").alias("doc_ids"))
