"""Exact Jaccard join of documents on their sets of five-word shingles.

Words are lower-cased (A-Z); a document's set has its distinct runs of five words, or its whole
sequence where it has fewer words. Two documents link when ``100 * shared >= 75 * all``; a component
is what can be reached by links.

The work:

1. *Sketches.* One pass over the texts gives each document its set size, a 128-bit sum of the set
   (equal sets become one representative), a few minima of its hashes, a hashed bitmap (bit h is the
   parity of the shingles that hash to it; its width grows with the size, so it is never saturated,
   and a wide one folds to a narrow one).
2. *Stars.* Representatives with an equal minimum are compared with one of them only, another one in each
   round, as long as they are not in one component. The links found so, verified, join large groups
   of near copies without pairing their members.
3. *Tiles.* In the order of the hashes, two linked sets have their first ``l`` common shingles among the
   first ``n - ceil(0.75 n) + l`` of each, the prefix; ``l`` is a twelfth of the size. A second pass over
   the texts reads the prefixes, so they are not stored, and cuts the hashes to as many bits as tell
   nearly all shingles of the input apart. Shingles in one prefix only are dropped, then documents with fewer prefix shingles left than any link would leave them, such
   as those that only share a passage. Of the others' shingles the last ``l - 1`` are not needed: the
   first one that two documents share is among the rest of both. Documents with a shingle in common and of the same or the next
   size band form a tile. Only pairs not yet in one component are compared: the number of bits in
   which two bitmaps differ bounds the overlap from above. Tiles with many rows are cut into
   blocks, each pair of blocks a task's work. Two documents that share many shingles meet in many tiles:
   every row names a few earlier shingles of its document, its witnesses, and two rows with a witness in
   common are left to that earlier tile. A tile whose rows all have one in common is dropped.
4. Pairs that pass are verified by intersecting the two sorted arrays of hashes, each pair once. Where many
   pairs pass in a tile, the most promising of each component go first; such tiles are compared again
   once the links found have joined components, the last time whole.

The result is that of comparing all pairs, up to 64-bit hash collisions of shingles.

Defined cases: null or empty texts and texts without words have size 0 and are their own component.
Rows with a null doc_id are returned with a null component and link with nothing. Rows that repeat a
doc_id each have their size; their links are those of the id. Other columns are ignored by
``classes`` and kept by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneleffect.llm import common
from paneleffect.llm.components import components


#: A link shares at least one in so many of its smaller set's shingles within the prefixes.
SURE = 12


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    minima: int = 4
    bits_per_shingle: int = 2
    least_bits: int = 128
    block_rows: int = 2048
    first_pairs: int = 2
    star_rounds: int = 2
    tile_rounds: int = 1


def sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    starts, ends, before = common.word_spans(data, offsets)
    hashes = common.word_hashes(data, starts, ends, lower=True)
    runs = common.run_hashes(hashes, words)
    for first, last in zip(before[:-1].tolist(), before[1:].tolist()):
        if last - first >= words:
            yield np.unique(runs[first : last - words + 1])
        else:
            yield common.run_hashes(hashes[first:last], last - first) if last > first else runs[:0]


def width(n: int, s: Settings) -> int:
    """Bits of the bitmap of a set of n: a power of two."""
    return max(s.least_bits, 1 << (s.bits_per_shingle * n - 1).bit_length())


def bitmap(own: np.ndarray, bits: int) -> np.ndarray:
    odd = np.bincount((own >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap, or rows of bitmaps, folded to so many 64-bit words; the top bits of a hash address it,
    so neighbours are folded together."""
    while bits.shape[-1] > words:
        bits = _squeezed(bits)
    return bits


_EVEN = [(1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)]


def _squeezed(bits: np.ndarray) -> np.ndarray:
    x = (bits ^ (bits >> np.uint64(1))) & np.uint64(0x5555555555555555)
    for shift, mask in _EVEN:
        x = (x | (x >> np.uint64(shift))) & np.uint64(mask)
    return x[..., 0::2] | (x[..., 1::2] << np.uint64(32))


#: Prefixes have keys, the top bits of a hash: equal shingles stay equal, and every pair is verified by whole
#: hashes. So many bits are kept beyond those that number all shingles; few different ones then have one key.
SPARE_BITS = 5


def _sure(n: int) -> int:
    """How many shared prefix shingles are asked of a link whose smaller set has n."""
    return max(1, n // SURE)


def _sketch(docs: DataFrame, s: Settings) -> DataFrame:
    """doc_id, n, f1, f2, minima and bitmap of every document."""
    minima = [f"m{k}" for k in range(s.minima)]
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), *[(m, pa.int64()) for m in minima], ("bits", pa.binary())])
    odd = (np.arange(s.minima, dtype=np.uint64) * np.uint64(2) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                rows = []
                for own in sets(data, offsets, s.words):
                    n = len(own)
                    if n:
                        least = [int((own * m).min().view(np.int64)) for m in odd]
                        rows.append((n, *_sums(own), *least, bitmap(own, width(n, s)).tobytes()))
                    else:
                        rows.append((0, 0, 0, *[0] * s.minima, None))
                named = dict(zip(["n", "f1", "f2", *minima, "bits"], zip(*rows)))
                yield common.records(schema, doc_id=part.column(0), **named)

    fields = ", ".join(f"{m} long" for m in minima)
    return docs.mapInArrow(scan, f"doc_id long, n long, f1 long, f2 long, {fields}, bits binary")


def _sums(own: np.ndarray) -> tuple[int, int]:
    """The two sums that tell sets apart."""
    return int(own.sum().view(np.int64)), int(common.mixed(own).sum().view(np.int64))


def _needed_share(n: int, s: Settings) -> int:
    """Less the overlap that a link needs of a set of n, whatever the other's size."""
    return -(s.percent * n) // 100


_PREFIX = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.binary())])


def _prefixes(docs: DataFrame, bits: int, s: Settings) -> DataFrame:
    """Columns of ``_PREFIX`` of the sets that are not empty, equal sets together, the smallest id first; a set that a
    batch has more than once leaves it once. A prefix has keys of so many bits, in their order, as steps from the one before."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[int, int, int], tuple[int, bytes]] = {}
            for part, data, offsets in common.slices(batch, "text"):
                for doc, own in zip(part.column(0).to_pylist(), sets(data, offsets, s.words)):
                    n = len(own)
                    if not n or doc is None:
                        continue
                    name = (n, *_sums(own))
                    if name in rows:
                        rows[name] = min(doc, rows[name][0]), rows[name][1]
                    else:
                        keys = own[: min(n, n + _needed_share(n, s) + _sure(n))] >> np.uint64(64 - bits)
                        rows[name] = doc, _planes(np.diff(keys, prepend=np.uint64(0)))
            if rows:
                n, f1, f2 = zip(*rows)
                doc_id, prefix = zip(*rows.values())
                yield common.records(_PREFIX, doc_id=doc_id, n=n, f1=f1, f2=f2, prefix=prefix)

    read = docs.mapInArrow(scan, "doc_id long, n long, f1 long, f2 long, prefix binary")
    return read.repartition("f1", "f2", "n").sortWithinPartitions("f1", "f2", "n", "doc_id")


def _planes(x: np.ndarray) -> bytes:
    """64-bit numbers as bytes, those of one weight together, so that compression finds the zeros."""
    return x.view(np.uint8).reshape(*x.shape, 8).swapaxes(-1, -2).tobytes()


def _numbers(planes: bytes, rows: int = 1) -> np.ndarray:
    """The 64-bit numbers of ``_planes``, in so many rows."""
    return np.frombuffer(planes, np.uint8).reshape(rows, 8, -1).swapaxes(-1, -2).copy(order="C").view(np.int64)[..., 0]


def _arrays(docs: DataFrame, ids: DataFrame, s: Settings) -> DataFrame:
    """doc_id and the sorted hashes of the named documents."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                own = [x.tobytes() for x in sets(data, offsets, s.words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own, pa.binary())], names=["doc_id", "hashes"])

    return docs.join(ids, "doc_id", "left_semi").mapInArrow(scan, "doc_id long, hashes binary")


def _likely(pairs: DataFrame, reps: DataFrame, s: Settings) -> DataFrame:
    """The pairs (a, b) whose bitmaps allow a link."""
    sized = reps.select("doc_id", "n", "bits")
    for side in ("a", "b"):
        pairs = pairs.join(sized.withColumnsRenamed({"doc_id": side, "n": f"_n{side}", "bits": f"_bits{side}"}), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for n, m, x, y in zip(*(batch.column(k).to_pylist() for k in range(2, 6))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                differ = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum(dtype=np.int64))
                good.append((n + m - differ) // 2 >= _needed_overlap(n, m, s))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "_na", "_nb", "_bitsa", "_bitsb").mapInArrow(check, "a long, b long").distinct()


def _verified(docs: DataFrame, pairs: DataFrame, s: Settings) -> DataFrame:
    """The staged pairs (a, b) that link, by exact intersection."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    arrays = common.stage(_arrays(docs, ids, s), "hash-arrays")
    both = pairs.join(arrays.withColumnsRenamed({"doc_id": "a", "hashes": "_a"}), "a").join(arrays.withColumnsRenamed({"doc_id": "b", "hashes": "_b"}), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(shared > 0 and 100 * shared >= s.percent * (len(x) + len(y) - shared))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return common.stage(both.select("a", "b", "_a", "_b").mapInArrow(check, "a long, b long").distinct(), "verified")


def _needed_overlap(x, y, s: Settings):
    """The least overlap of two linked sets of these sizes: 100 o >= percent (x + y - o)."""
    return -(-s.percent * (x + y) // (100 + s.percent))


def _passing(n: np.ndarray, comp: np.ndarray, bits: list[bytes], side: np.ndarray, seen: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows whose components differ, that have no witness in common and whose bitmaps allow a
    link, with the bound's share."""
    words = min(map(len, bits)) // 8
    flat = np.stack([folded(np.frombuffer(b, np.uint64), words) for b in bits])
    found = ([], [], [])
    rows = np.arange(len(n))
    step = max(1, (1 << 19) // len(n))
    for first in range(0, len(n), step):
        i = rows[first : first + step, None]
        ok = (comp[i] != comp) & (i < rows) & ((side[i] == 0) | (side == 0))
        ok &= 100 * np.minimum(n[i], n) >= s.percent * np.maximum(n[i], n)
        for w in seen:
            ok &= (w[i] != w) | (w < 0)
        x, y = np.nonzero(ok)
        x = x + first
        for k in range(0, len(x), max(1, (1 << 20) // words)):
            p, q = x[k : k + max(1, (1 << 20) // words)], y[k : k + max(1, (1 << 20) // words)]
            differ = np.bitwise_count(flat[p] ^ flat[q]).sum(axis=1, dtype=np.int64)
            most = (n[p] + n[q] - differ) // 2
            good = most >= _needed_overlap(n[p], n[q], s)
            for column, value in zip(found, (p[good], q[good], most[good] / (n[p] + n[q])[good])):
                column.append(value)
    if not found[0]:
        return rows[:0], rows[:0], rows[:0].astype(float)
    return tuple(map(np.concatenate, found))


def _promising(x: np.ndarray, y: np.ndarray, share: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the ``most`` with the largest share of one of their two components: as
    many as there are components, times ``most``, however many pairs there are."""
    comp, pair = np.concatenate([x, y]), np.tile(np.arange(len(x)), 2)
    order = np.lexsort((pair, -share[pair], comp))
    comp = comp[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = comp[1:] != comp[:-1]
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return np.unique(pair[order[rank < most]])


_KEY = ["key", "band", "low", "high"]
_WITNESSES = ["w0", "w1", "w2"]


def _compared(rows: DataFrame, s: Settings, whole: bool) -> DataFrame:
    """Pairs (a, b) that pass in a tile, and, with null a, the tiles of which not all are returned:
    unless ``whole``, only the ``first_pairs`` most promising of each component.

    ``rows``: the tile's key, doc_id, n, comp, bits, witnesses, side (pairs of two rows of side 1 belong
    to the band below).
    """
    dealt = rows.select(*_KEY, "doc_id", "n", "comp", "side", *_WITNESSES, "bits").repartition(*_KEY).sortWithinPartitions(*_KEY)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("band", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])

    def judge(table: pa.Table) -> pa.RecordBatch:
        key, band, low, high, doc, n, comp, side = (table.column(k).combine_chunks().to_numpy() for k in range(8))
        seen = np.stack([table.column(w).combine_chunks().to_numpy() for w in _WITNESSES])
        bits = table.column("bits").to_pylist()
        tile = np.stack([key, band, low, high])
        cuts = np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1
        pairs, unfinished = set(), []
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(doc)]):
            own = slice(first, last)
            if last - first < 2 or (comp[own] == comp[first]).all():
                continue
            p, q, share = _passing(n[own], comp[own], bits[own], side[own], seen[:, own], s)
            if not whole and len(p) > s.first_pairs:
                kept = _promising(comp[own][p], comp[own][q], share, s.first_pairs)
                if len(kept) < len(p):
                    unfinished.append(first)
                p, q = p[kept], q[kept]
            x, y = doc[own][p], doc[own][q]
            pairs.update(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()))
        a, b = zip(*pairs) if pairs else ((), ())
        none = [None] * len(unfinished)
        return common.records(schema, a=[*a, *none], b=[*b, *none], **{c: [*[None] * len(a), *v[unfinished].tolist()] for c, v in zip(_KEY, tile)})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:  # a tile may go on in the next batch: hold its rows back
            if not len(batch):
                continue
            table = pa.Table.from_batches([*held, batch])
            columns = [table.column(k).combine_chunks().to_numpy() for k in range(4)]
            other = np.any([c != c[-1] for c in columns], axis=0)
            begin = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            if begin:
                yield judge(table.slice(0, begin))
            held = table.slice(begin).to_batches()
        if held:
            yield judge(pa.Table.from_batches(held))

    return common.stage(dealt.mapInArrow(compare, "a long, b long, key long, band int, low int, high int"), "candidates")


def _tile_rows(tiles: DataFrame, reps: DataFrame, comps: DataFrame, s: Settings, only: DataFrame | None = None) -> DataFrame:
    """Rows of the tiles, or of ``only`` some, that hold more than one component, large tiles cut into
    pairs of blocks."""
    if only is not None:
        tiles = tiles.join(only.select("key", "band").distinct(), ["key", "band"], "left_semi")
    comp = F.coalesce("component", F.col("doc_id")).alias("comp")
    rows = tiles.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "band", "doc_id", "side", *_WITNESSES, comp)
    rows = common.stage(rows, "tile-rows")
    sizes = rows.groupBy("key", "band").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("side").alias("own"))
    live = sizes.where("x <> y and own = 0").select("key", "band", F.ceil(F.col("rows") / s.block_rows).cast("int").alias("blocks"))
    rows = rows.join(live, ["key", "band"])
    # A row of block k is needed in the pairs (0, k) ... (k, k), (k, k + 1) ... (k, blocks - 1).
    block = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    cut = rows.select("key", "band", "doc_id", "side", *_WITNESSES, "comp", block.alias("block"), other)
    cut = cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    cut = cut if only is None else cut.join(only, _KEY, "left_semi")
    return cut.join(reps.select("doc_id", "n", "bits"), "doc_id").drop("block", "other")


def _stars(reps: DataFrame, comps: DataFrame | None, turn: int, s: Settings) -> DataFrame:
    """(a, b): each representative with one of those that share a minimum, the smallest by a hash that
    changes with the round; only of fitting size and of another component."""
    slim = reps.select("doc_id", "n", *[f"m{k}" for k in range(s.minima)], F.xxhash64("doc_id", F.lit(turn)).alias("_o"))
    if comps is None:
        slim = slim.withColumn("comp", F.col("doc_id"))
    else:
        slim = slim.join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("comp", F.coalesce("component", "doc_id"))
    pairs = None
    for k in range(s.minima):
        centre = slim.groupBy(f"m{k}").agg(
            F.min_by("doc_id", "_o").alias("a"), F.min_by("n", "_o").alias("na"), F.min_by("comp", "_o").alias("ca"), F.min("comp").alias("x"), F.max("comp").alias("y")
        )
        near = slim.join(centre.where("x <> y"), f"m{k}")
        near = near.where((F.col("comp") != F.col("ca")) & (F.least("n", "na") * 100 >= F.greatest("n", "na") * s.percent))
        near = near.select(F.least("a", "doc_id").alias("a"), F.greatest("a", "doc_id").alias("b"))
        pairs = near if pairs is None else pairs.unionByName(near)
    return pairs.distinct()


def links(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, doc_id to representative, components of the representatives)."""
    sketched = common.stage(_sketch(docs, s), "sketches")
    rows = sketched.where("n > 0 and doc_id is not null")
    shingles = rows.agg(F.sum("n")).first()[0] or 0
    same = rows.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    mapped = common.stage(rows.select("doc_id", "f1", "f2", "n").join(same, ["f1", "f2", "n"]).select("doc_id", "rep"), "representatives")
    chosen = mapped.select(F.col("rep").alias("doc_id")).distinct()
    reps = rows.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id", "f1", "f2", "n"])
    reps = common.stage(reps, "distinct-sets")

    # A repeated id that stands for one set and has a copy of another's is linked with that one.
    again = mapped.where("doc_id <> rep").join(chosen, "doc_id", "left_semi").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    tried = common.stage(again.distinct(), "tried")
    comps = None if tried.isEmpty() else common.stage(components(tried), "components")
    for turn in range(s.star_rounds):
        pairs = _stars(reps, comps, turn, s).join(tried, ["a", "b"], "left_anti")
        tried, comps = _joined(docs, _likely(pairs, reps, s), tried, comps, s)

    tiles = common.stage(_tiles(docs, shingles, s), "tiles")
    only = None
    for turn in range(s.tile_rounds + 1):
        candidates = _compared(_tile_rows(tiles, reps, comps, s, only), s, turn == s.tile_rounds)
        pairs = candidates.where("a is not null").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
        tried, comps = _joined(docs, pairs, tried, comps, s)
        only = candidates.where("a is null").select(*_KEY)
        if only.isEmpty():
            break
    return sketched, mapped, comps


def _joined(docs: DataFrame, pairs: DataFrame, tried: DataFrame, comps: DataFrame | None, s: Settings) -> tuple[DataFrame, DataFrame]:
    """All pairs verified so far, and the components with the links among ``pairs``."""
    pairs = common.stage(pairs, "pairs")
    new = _verified(docs, pairs, s)
    if comps is not None:
        new = comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(new)
    return tried.unionByName(pairs), common.stage(components(new), "components")


_KNOWN, _ASKED, _TOLD = 1, 2, 3
_BLOCK = pa.schema([("part", pa.int32()), ("rows", pa.binary())])
#: Prefix rows that a task packs, or settles, at once, about.
_PART_ROWS = 1 << 19


def _packed(kind: np.ndarray, key: np.ndarray, doc: np.ndarray, n: np.ndarray) -> bytes:
    """The columns as compressed bytes, after their number; ids and sizes as steps from the one before."""
    steps = [np.diff(x, prepend=0) for x in (doc, n)]
    flat = np.stack([kind, key, *[(step << 1) ^ (step >> 63) for step in steps]])
    return len(key).to_bytes(8, "little") + pa.compress(_planes(flat), codec="zstd", asbytes=True)


def _unpacked(block: bytes) -> np.ndarray:
    """kind, key, doc_id and n, one row each."""
    size = 32 * int.from_bytes(block[:8], "little")
    if not size:
        return np.zeros((4, 0), np.int64)
    out = _numbers(pa.decompress(block[8:], decompressed_size=size, codec="zstd", asbytes=True), 4)
    for k in (2, 3):
        out[k] = np.cumsum((out[k].view(np.uint64) >> np.uint64(1)).view(np.int64) ^ -(out[k] & 1))
    return out


def _blocks(part: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """The rows of each part in one block, by kind and id."""
    order = np.lexsort((columns[2], columns[0], part))
    cuts = np.flatnonzero(np.diff(part[order])) + 1
    owns = [own for own in np.split(order, cuts) if len(own)]
    return common.records(_BLOCK, part=[int(part[own[0]]) for own in owns], rows=[_packed(*(c[own] for c in columns)) for own in owns])


def _dealt(blocks: DataFrame, work: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` on the rows of each part, one part after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if part != last and held:
                    yield work(last, np.concatenate(held, axis=1))
                    held = []
                last = part
                held.append(_unpacked(block))
        if held:
            yield work(last, np.concatenate(held, axis=1))

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, schema)


def _shared(prefixes: DataFrame, parts: int) -> DataFrame:
    """Blocks, dealt by document, of the prefix keys that more than one document has in its prefix.

    A key that a chunk has more than once is known to be shared there; one row tells the other
    chunks, so a key of very many documents is gathered once per chunk. Rows travel in blocks, one
    per chunk and part of the keys; the part of an asked or told key is left out of it.
    """

    def chunk(doc: np.ndarray, n: np.ndarray, lists: list[np.ndarray]) -> pa.RecordBatch:
        keys, sizes = np.concatenate(lists), list(map(len, lists))
        doc, n = np.repeat(doc, sizes), np.repeat(n, sizes)
        value, back, count = np.unique(keys, return_inverse=True, return_counts=True)
        many, told = (count > 1)[back], value[count > 1]
        del value, back, count
        none = np.zeros(len(told), np.int64)
        spread = (common.mixed(keys.view(np.uint64) ^ doc.view(np.uint64)) % np.uint64(parts)).view(np.int64)
        part = np.concatenate([np.where(many, spread, keys % parts), told % parts])
        kind = np.concatenate([np.where(many, _KNOWN, _ASKED), none + _TOLD])
        return _blocks(part, kind, np.concatenate([np.where(many, keys, keys // parts), told // parts]), np.concatenate([doc, none]), np.concatenate([n, none]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_set = None
        for batch in batches:
            if not len(batch):
                continue
            names = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)])
            other = np.ones(len(batch), dtype=bool)
            other[1:] = (names[:, 1:] != names[:, :-1]).any(axis=0)
            other[0] = last_set is None or (names[:, 0] != last_set).any()
            last_set = names[:, -1].copy()
            doc, n, prefix = batch.column(0).to_numpy()[other], names[0][other], batch.column(4).filter(pa.array(other)).to_pylist()
            ends = np.cumsum([len(x) // 8 for x in prefix])
            cuts = np.flatnonzero(np.diff(ends // _PART_ROWS)) + 1
            for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(prefix)]):
                if last > first:
                    yield chunk(doc[first:last], n[first:last], [np.cumsum(_numbers(x)[0]) for x in prefix[first:last]])

    def settled(part: int, rows: np.ndarray) -> pa.RecordBatch:
        kind, key, doc, n = rows
        open_ = np.flatnonzero(kind != _KNOWN)
        key[open_] = key[open_] * parts + part
        _, back, count = np.unique(key[open_], return_inverse=True, return_counts=True)
        kept = (kind == _KNOWN) | (kind == _ASKED)
        kept[open_] &= count[back] > 1
        key, doc, n = key[kept], doc[kept], n[kept]
        own = (common.mixed(doc.view(np.uint64)) % np.uint64(parts)).view(np.int64)
        return _blocks(own, np.zeros_like(key), key, doc, n)

    return _dealt(prefixes.mapInArrow(emit, "part int, rows binary"), settled, "part int, rows binary")


def _first_rows(key: np.ndarray, doc: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """key, doc_id, n and witnesses of the rows of whole documents that are needed: in the order of the
    keys, all but the last ``l - 1`` of a document.

    Different shingles of a document may have one key. Its witnesses are smaller keys, never the key
    itself, so a pair is left to an earlier tile each time.
    """
    order = np.lexsort((key, n, doc))
    key, doc, n = key[order], doc[order], n[order]
    rows = np.arange(len(key))
    head = np.ones(len(key), dtype=bool)
    head[1:] = (doc[1:] != doc[:-1]) | (n[1:] != n[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)[group]
    count = np.bincount(group)[group]
    sure = np.maximum(1, n * s.percent // 100 // SURE)  # of the smallest set that n can link with
    fresh = head.copy()
    fresh[1:] |= key[1:] != key[:-1]
    before = np.maximum.accumulate(np.where(fresh, rows, 0)) - 1  # the last row with a smaller key
    found = [before]
    for k in (1, 2):  # the least by a hash so far, anew in each group
        hashed = common.mixed(key.view(np.uint64) * np.uint64(2 * k + 1)) >> np.uint64(32)
        ranked = ((group[-1:] - group) << 32) | hashed.view(np.int64)
        least = np.maximum.accumulate(np.where(ranked == np.minimum.accumulate(ranked), rows, 0))
        found.append(least[before])
    seen = [np.where(before >= first, key[x], -1) for x in found]
    kept = rows - first <= count - sure
    return tuple(c[kept] for c in (key, doc, n, *seen))


def _tiles(docs: DataFrame, shingles: int, s: Settings) -> DataFrame:
    """key, band, doc_id, side and witnesses of the documents that may have links; side 1 are the rows of
    the band below. ``shingles``: the sizes of all sets together.

    Witnesses are keys that the document has in earlier tiles (-1: none): the one before, and those
    least by two hashes. Where all documents of a tile have one in common, they all meet in that
    earlier tile, in the same bands, and this one is dropped; so are tiles of one document.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-shingles // (3 * _PART_ROWS)))
    names = ["key", "doc_id", "n", *_WITNESSES]

    def first_rows(_: int, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in _first_rows(*rows[1:], s)], names=names)

    prefixes = _prefixes(docs, min(48, shingles.bit_length() + SPARE_BITS), s)
    kept = common.stage(_dealt(_shared(prefixes, parts), first_rows, ", ".join(f"{c} long" for c in names)), "prefix-rows")
    spans = [(F.min(w).alias(f"{w}_least"), F.max(w).alias(f"{w}_most")) for w in _WITNESSES]
    sizes = kept.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), *[e for span in spans for e in span])
    first = sizes.where(" and ".join(["rows > 1", *[f"({w}_least < 0 or {w}_least < {w}_most)" for w in _WITNESSES]]))
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / s.percent)) + 1e-9).cast("int")
    sides = F.explode(F.array(F.struct(band.alias("band"), F.lit(0).alias("side")), F.struct((band + 1).alias("band"), F.lit(1).alias("side"))))
    return kept.join(first.select("key"), "key", "left_semi").select("key", "doc_id", *_WITNESSES, sides.alias("t")).select("key", "t.band", "doc_id", "t.side", *_WITNESSES)


def _usable(docs: DataFrame) -> DataFrame:
    return common.needed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def classes(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    sketched, mapped, comps = links(_usable(docs), s)
    named = mapped.distinct().join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    named = named.groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    rows = sketched.select("doc_id", F.col("n").alias("n_shingles"))
    return rows.join(named, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, all columns kept. Of rows that
    repeat an id all stay or none; rows with a null id stay."""
    gone = classes(docs, s).where("doc_id <> component_id").select(F.col("doc_id").alias("_later")).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("_later"), "left_anti")
