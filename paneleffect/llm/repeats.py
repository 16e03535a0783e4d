"""Substring de-duplication by groups of suffixes that share a part of their prefix.

No suffix tree is built: of each suffix only its first 20 words matter to the result, and those are
compared inside groups of suffixes that share a part of them.

A window is 20 consecutive words of a document, unchanged. Every word covered by a window whose
words also start earlier (in a document with a smaller id, or earlier in the same one) is removed;
all windows are judged on the input.

The work:

1. The prefix of a suffix, its first 20 words, has an anchor: its run of 8 words with the smallest
   hash, the leftmost of equals. Equal windows have equal anchors, so a window whose anchor occurs
   once in the corpus cannot repeat. One pass emits the anchors, about one for seven words; those
   that occur once are dropped.
2. Suffixes are split into groups by a part of their prefix: by the anchor, or, where an anchor
   occurs more often than ``group_rows`` times, by the whole 20 words, so that every group fits in
   memory. Neighbouring suffixes of a group travel as one stretch of words.
3. Each group's suffixes are sorted word by word; neighbours that agree in 20 words are a repeat: the
   earliest stays, the others are removed. Runs of removed windows are maximal repeats.

Both passes first settle what they can inside a slice of a few megabytes of text: of equal windows
there only the earliest goes on. A passage that a third of all documents share therefore reaches
its group once per slice, not once per document. Words travel as 32-bit hashes beside a 64-bit
hash of the anchor or window they belong to.

Defined cases: null texts have no words, and an empty text, or one of white space, neither; texts
under 20 words are kept whole. Rows that repeat a doc_id are one place: their equal windows at the
same start do not remove each other, and a removal holds for all of them. Rows with a null doc_id
are kept whole and compared with nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect.llm import common


@dataclass(frozen=True)
class Settings:
    window: int = 20
    anchor: int = 8
    slice_bytes: int = 4 << 20
    group_rows: int = 4096


class _Windows:
    """The windows of a slice of documents in ascending id order."""

    def __init__(self, part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, s: Settings):
        starts, ends, before = common.word_spans(data, offsets)
        self.words = common.word_hashes(data, starts, ends, lower=False)
        self.ids = part.column(0).to_numpy(zero_copy_only=False)
        sizes = np.diff(before)
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.number = np.arange(len(self.words)) - np.repeat(before[:-1], sizes)
        n = max(0, len(self.words) - s.window + 1)
        whole = self.number[:n] + s.window <= sizes[self.doc[:n]]
        self.at = np.flatnonzero(whole)
        self.before = before
        if not len(self.at):
            return
        grams = common.run_hashes(self.words, s.anchor)
        inside = s.window - s.anchor + 1
        least = grams[:n].copy()
        for d in range(1, inside):
            np.minimum(least, grams[d : n + d], out=least)
        self.anchor_at = np.zeros(n, dtype=np.int64)
        for d in range(inside - 1, -1, -1):
            hit = np.flatnonzero(grams[d : n + d] == least)
            self.anchor_at[hit] = hit + d
        self.anchors = grams
        self.hashes = common.run_hashes(self.words, s.window)

    def place(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.doc[at]], self.number[at]

    def later(self, at: np.ndarray) -> np.ndarray:
        """Which of these windows also start earlier within the slice."""
        order = np.argsort(self.hashes[at], kind="stable")
        ordered = self.hashes[at][order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = ordered[1:] != ordered[:-1]
        first = at[order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]]
        out = np.empty(len(at), dtype=bool)
        own_id, own_number = self.place(at[order])
        first_id, first_number = self.place(first)
        out[order] = (own_id > first_id) | ((own_id == first_id) & (own_number > first_number))
        return out

    def runs(self, at: np.ndarray, together: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """First and last of each run of consecutive windows of a document (with equal ``together``)."""
        cut = np.ones(len(at), dtype=bool)
        cut[1:] = (np.diff(at) != 1) | (self.doc[at[1:]] != self.doc[at[:-1]])
        if together is not None:
            cut[1:] |= together[1:] != together[:-1]
        begin = np.flatnonzero(cut)
        return at[begin], at[np.append(begin[1:], len(at)) - 1] if len(at) else at


def _slices(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[tuple[pa.RecordBatch, _Windows]]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        if len(ids) > 1 and (np.diff(ids) < 0).any():
            batch = batch.take(pa.array(np.argsort(ids, kind="stable")))
        for part, data, offsets in common.slices(batch, "text", s.slice_bytes):
            yield part, _Windows(part, data, offsets, s)


# ``at`` is the place of the first word, times four, plus the kind; ``value`` the last place of a run of
# settled windows, or the anchor of a known place. Few and narrow columns keep the shuffle small.
_FOUND = pa.schema([("key", pa.int64()), ("value", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])
_FOUND_SQL = "key long, value long, doc_id long, at long"
_GONE, _KNOWN, _ASKED, _TOLD = 0, 1, 2, 3


def _spread(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return common.as_long(common.mixed(doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + lo.astype(np.uint64)))


def _anchors(docs: DataFrame, s: Settings) -> DataFrame:
    """Windows settled within their slice (kind 0), and anchors: of one that occurs twice in a slice all
    places are known to repeat (1) and one row tells the other slices (3); others ask (2)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, w in _slices(batches, s):
            if not len(w.at):
                continue
            late = w.later(w.at)
            first, last = w.runs(w.at[late])
            places = np.unique(w.anchor_at[w.at[~late]])
            value, back, count = np.unique(w.anchors[places], return_inverse=True, return_counts=True)
            many = count[back] > 1
            gone_doc, gone_lo = w.place(first)
            doc, number = w.place(places)
            told = common.as_long(value[count > 1])
            kind = np.concatenate([np.full(len(first), _GONE), np.where(many, _KNOWN, _ASKED), np.full(len(told), _TOLD)])
            own, none = common.as_long(w.anchors[places]), np.zeros(len(told), np.int64)
            yield common.records(
                _FOUND,
                key=np.concatenate([_spread(gone_doc, gone_lo), np.where(many, _spread(doc, number), own), told]),
                value=np.concatenate([w.number[last], np.where(many, own, 0), none]),
                doc_id=np.concatenate([gone_doc, doc, none]),
                at=np.concatenate([gone_lo, number, none]) * 4 + kind,
            )

    return docs.mapInArrow(emit, _FOUND_SQL)


def _repeating(anchors: DataFrame) -> DataFrame:
    """Kinds 0 and 1 as they are, and those that asked whose anchor occurs elsewhere, as kind 1."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            known = batch.column(3).to_numpy() & 3 <= _KNOWN
            yield batch.filter(pa.array(known)).select(["value", "doc_id", "at"])
            held.append(batch.filter(pa.array(~known)))
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        key, at = table.column(0).to_numpy(), table.column(3).to_numpy()
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        kept = np.flatnonzero((count[back] > 1) & (at & 3 == _ASKED))
        doc = table.column(2).to_numpy()[kept]
        yield pa.RecordBatch.from_arrays([pa.array(key[kept]), pa.array(doc), pa.array(at[kept] - _ASKED + _KNOWN)], names=["value", "doc_id", "at"])

    return anchors.repartition("key").mapInArrow(settle, "value long, doc_id long, at long")


_STRETCH = pa.schema([("gone", pa.bool_()), ("key", pa.int64()), ("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("words", pa.binary())])
_STRETCH_SQL = "gone boolean, key long, doc_id long, lo int, hi int, words binary"


def _stretches(docs: DataFrame, wanted: DataFrame, s: Settings) -> DataFrame:
    """The suffixes at repeating anchors, neighbours as one stretch; windows settled here are ``gone``."""
    # A left join, as for the final texts: both then use one shuffle of the documents. Rows without
    # places leave before they are looked at.
    texts = docs.join(wanted, F.col("doc_id") == F.col("_doc"), "left").select("doc_id", "text", "places", "frequent")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = (b for b in (x.filter(pc.is_valid(x.column(2))) for x in batches) if len(b))
        for part, w in _slices(used, s):
            if not len(w.at):
                continue
            lists = [part.column(k) for k in (2, 3)]
            marks = []
            for column in lists:
                mark = np.zeros(len(w.words), dtype=bool)
                sizes = np.array([len(x) if x.is_valid else 0 for x in column])
                flat = [p for x in column if x.is_valid for p in x.as_py()]
                mark[np.repeat(w.before[:-1], sizes) + np.array(flat, dtype=np.int64)] = True
                marks.append(mark)
            at = w.at[marks[0][w.anchor_at[w.at]]]
            late = w.later(at)
            first, last = w.runs(at[late])
            doc, lo = w.place(first)
            yield common.records(_STRETCH, gone=[True] * len(first), key=[0] * len(first), doc_id=doc, lo=lo, hi=w.number[last], words=[None] * len(first))
            at = at[~late]
            often = marks[1][w.anchor_at[at]]
            one, few = at[often], at[~often]
            first, last = w.runs(few, w.anchor_at[few])
            key = np.concatenate([w.anchors[w.anchor_at[first]], w.hashes[one]])
            first, last = np.concatenate([first, one]), np.concatenate([last, one])
            raw = (w.words & np.uint64(0xFFFFFFFF)).astype(">u4").tobytes()
            words = [raw[4 * a : 4 * (b + s.window)] for a, b in zip(first.tolist(), last.tolist())]
            doc, lo = w.place(first)
            yield common.records(_STRETCH, gone=[False] * len(first), key=common.as_long(key), doc_id=doc, lo=lo, hi=w.number[last], words=words)

    return texts.mapInArrow(cut, _STRETCH_SQL)


def _subtree(key: np.ndarray, doc: np.ndarray, start: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Which suffixes are not the earliest leaf of their deep node. ``prefix``: suffix x word, sorted
    word by word; equal neighbours share a node of the full depth."""
    order = np.lexsort((start, doc))
    wide = np.concatenate([key.astype(">i8").view(np.uint8).reshape(-1, 8), prefix.view(np.uint8).reshape(len(prefix), -1)], axis=1)
    texts = np.ascontiguousarray(wide[order]).view(f"S{wide.shape[1]}").ravel()
    order = order[np.argsort(texts, kind="stable")]
    agree = (key[order][1:] == key[order][:-1]) & (prefix[order][1:] == prefix[order][:-1]).all(axis=1)
    head = np.ones(len(order), dtype=bool)
    head[1:] = ~agree
    first = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    out = np.empty(len(order), dtype=bool)
    out[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return out


def _nodes(stretches: DataFrame, s: Settings, portion: int = 1 << 16) -> DataFrame:
    """doc_id, lo, hi of the removed windows: those settled before, and those of all groups."""
    dealt = stretches.repartition("key").sortWithinPartitions("key")
    schema = pa.schema([("doc_id", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])

    def judge(table: pa.Table) -> pa.RecordBatch:
        key, doc, lo, hi = (table.column(k).combine_chunks().to_numpy() for k in (1, 2, 3, 4))
        size = (hi - lo + 1).astype(np.int64)
        words = np.frombuffer(b"".join(table.column(5).to_pylist()), dtype=">u4")
        length = size + s.window - 1
        begin = np.repeat(np.cumsum(length) - length, size)
        step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        prefix = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(words, s.window)[begin + step])
        row = np.repeat(np.arange(len(size)), size)
        start = lo[row] + step
        late = _subtree(key[row], doc[row], start, prefix)
        return common.records(schema, doc_id=doc[row][late], lo=start[late], hi=start[late])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            yield batch.filter(batch.column(0)).select(["doc_id", "lo", "hi"])
            batch = batch.filter(pc.invert(batch.column(0)))
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            if rows >= portion:  # judge all groups but the last, which may go on
                table = pa.Table.from_batches(held).combine_chunks()
                keys = table.column(1).to_numpy()
                end = int(np.searchsorted(keys, keys[-1]))
                if end:
                    yield judge(table.slice(0, end))
                held = table.slice(end).to_batches()
                rows = len(table) - end
        if rows:
            yield judge(pa.Table.from_batches(held))

    return dealt.mapInArrow(groups, "doc_id long, lo int, hi int")


def removed_windows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, lo, hi: runs of windows, by the number of their first word, that also start earlier.
    A run may be reported in parts, or more than once."""
    docs = common.needed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    found = common.stage(_repeating(_anchors(usable, s)), "anchors")
    kind, lo = F.col("at").bitwiseAND(F.lit(3)), F.shiftright("at", 2).cast("int").alias("lo")
    places = found.where(kind == _KNOWN).select(F.col("doc_id").alias("_doc"), lo, F.col("value").alias("anchor"))
    often = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > s.group_rows)
    marked = places.join(often, "anchor", "left")
    wanted = marked.groupBy("_doc").agg(
        F.collect_set("lo").alias("places"), F.collect_set(F.when(F.col("n").isNotNull(), F.col("lo"))).alias("frequent")
    )
    settled = found.where(kind == _GONE).select("doc_id", lo, F.col("value").cast("int").alias("hi"))
    return settled.unionByName(_nodes(_stretches(docs, wanted, s), s))


def covered(n: int, spans: list[tuple[int, int]], window: int) -> np.ndarray:
    """Which of n words lie in one of the windows whose first words are lo to hi."""
    depth = np.zeros(n + 1, dtype=np.int64)
    for lo, hi in spans:
        depth[lo] += 1
        depth[min(hi + window, n)] -= 1
    return np.cumsum(depth[:n]) > 0


def deduplicated(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of every row."""
    docs = common.needed(docs, "doc_id", "text")
    spans = removed_windows(docs, s).groupBy(F.col("doc_id").alias("_doc")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    joined = docs.join(spans, F.col("doc_id").cast("long") == F.col("_doc"), "left").select("doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, one in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()
                out = 0
                if one.is_valid:
                    lo, hi = (one.values.field(k).to_numpy() for k in (0, 1))
                    mark = covered(len(words), list(zip(lo.tolist(), hi.tolist())), s.window)
                    out = int(mark.sum())
                    words = [w for w, m in zip(words, mark.tolist()) if not m]
                n.append(len(words) + out)
                gone.append(out)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return deduplicated(docs, s).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH worded AS (
  SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS MATERIALIZED (
  SELECT doc_id, i, MD5(ARRAY_TO_STRING(w[i:i + 19], ' ')) AS h FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 18)) AS i FROM worded WHERE LEN(w) >= 20)
), firsts AS (
  SELECT h, MIN({'d': doc_id, 'i': i}) AS p FROM windows GROUP BY h HAVING COUNT(*) > 1
), late AS (
  SELECT w.doc_id, w.i FROM windows w JOIN firsts f USING (h) WHERE f.p < {'d': w.doc_id, 'i': w.i}
), gone AS (
  SELECT doc_id, LIST(DISTINCT i + k) AS spots FROM late, RANGE(0, 20) AS r(k) GROUP BY doc_id
), kept AS (
  SELECT worded.doc_id, LEN(w) AS n, COALESCE(LEN(spots), 0) AS out,
    CASE WHEN spots IS NULL THEN w ELSE LIST_FILTER(w, lambda x, i: NOT LIST_CONTAINS(spots, i)) END AS k
  FROM worded LEFT JOIN gone ON worded.doc_id = gone.doc_id
)
SELECT doc_id, n::BIGINT AS n_words, out::BIGINT AS n_removed, SHA256(COALESCE(ARRAY_TO_STRING(k, ' '), '')) AS kept_sha256 FROM kept
"""
