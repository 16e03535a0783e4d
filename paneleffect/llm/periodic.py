"""Periodic runs of words, by suffix trees and Lyndon roots.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that
no neighbouring word extends. Every run holds a Lyndon word of q words that is the longest Lyndon word
starting at its first word, in the order of the words or in the reversed one. So the work on a text is:

1. Ukkonen's suffix trees of the text and of its reversal. An Euler tour of a tree with range minima over
   its depths answers in constant time how far two suffixes agree (the depth of their lowest common
   ancestor); the tour of the first tree also ranks the suffixes.
2. The longest Lyndon word at a place ends where the next smaller suffix starts, or, in the reversed
   order, the next greater one. Each gives a candidate root.
3. A candidate with period p at place i is extended as far as the suffixes at i and i + p agree, and to
   the left as the reversal's do. What reaches the length asked for is a run, and all runs are found.

Words that cannot lie in a run are set aside first, without loss: in a run each word occurs four times,
so a word that occurs less often in its stretch of text splits the stretch, again and again until nothing
changes. What remains of a slice of documents goes into one pair of trees, the stretches kept apart by
symbols that occur once, which no run can cross. Rows are independent: one scan, no shuffle; memory is
that of one slice, or of one long text (about half a kilobyte a word that remains).

Defined cases: null and empty texts, and those of white space, have no words, no runs and an empty
``collapsed``. Repeated rows and null ids are treated like others. Other columns are ignored. No rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect.llm import common

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Settings:
    least: int = 6  # words of a run
    exponent: int = 4  # periods of a run, at least two
    slice_bytes: int = 1 << 19
    rounds: int = 12  # of setting words aside; more only save work


class SuffixTree:
    """Ukkonen's tree of a row of numbers whose last one occurs nowhere else.

    ``rank`` is the place of each suffix in their order; ``agreement`` how far two suffixes agree.
    """

    def __init__(self, symbols: np.ndarray):
        text, width = symbols.tolist(), int(symbols.max()) + 1
        start, end, child = _ukkonen(text, width)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        below = np.fromiter(child.values(), np.int64, len(child))
        del child
        parent, symbol = keys // width, keys % width
        order = np.lexsort((symbol, parent))
        first = np.searchsorted(parent[order], np.arange(len(start) + 1))
        span = (np.array(end) - np.array(start)).tolist()
        depths, at, leaf = _euler_tour(below[order].tolist(), first.tolist(), span, len(text))
        self.seen = np.array(at, dtype=np.int64)
        self.minima = _Minima(np.array(depths, dtype=np.int32))
        self.rank = np.empty(len(text), dtype=np.int64)
        self.rank[leaf] = np.arange(len(text))

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at a and at b, which differ, have in common."""
        x, y = self.seen[a], self.seen[b]
        return self.minima.between(np.minimum(x, y), np.maximum(x, y))


def _ukkonen(text: list[int], width: int) -> tuple[list[int], list[int], dict[int, int]]:
    """Start and end of each node's edge, and the child of (node, first symbol) as one key."""
    size = len(text)
    start, end, link, child = [0], [0], [0], {}
    node = edge = length = pending = 0
    for i, symbol in enumerate(text):
        pending += 1
        waiting = 0
        while pending:
            if not length:
                edge = i
            key = node * width + text[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(start)
                start.append(i)
                end.append(size)
                link.append(0)
                if waiting:
                    link[waiting] = node
                    waiting = 0
            else:
                begin = start[below]
                span = end[below] - begin
                if length >= span:  # walk down
                    edge += span
                    length -= span
                    node = below
                    continue
                if text[begin + length] == symbol:
                    length += 1
                    if waiting:
                        link[waiting] = node
                    break
                split = len(start)
                child[key] = split
                child[split * width + text[begin + length]] = below
                child[split * width + symbol] = split + 1
                start[below] = begin + length
                start += (begin, i)
                end += (begin + length, size)
                link += (0, 0)
                if waiting:
                    link[waiting] = split
                waiting = split
            pending -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - pending + 1
    return start, end, child


def _euler_tour(below: list[int], first: list[int], span: list[int], size: int) -> tuple[list[int], list[int], list[int]]:
    """Depths along the tour of the tree, where each suffix's leaf stands in it, and the suffixes in
    the order of their leaves."""
    depths, at, leaf = [0], [0] * size, []
    path, upto, depth = [0], [first[0]], [0]
    while path:
        node, k = path[-1], upto[-1]
        if k == first[node + 1]:
            path.pop()
            upto.pop()
            depth.pop()
            if path:
                depths.append(depth[-1])
            continue
        upto[-1] = k + 1
        kid = below[k]
        deep = depth[-1] + span[kid]
        if first[kid] == first[kid + 1]:
            suffix = size - deep
            at[suffix] = len(depths)
            leaf.append(suffix)
            depths += (deep, depth[-1])
        else:
            path.append(kid)
            upto.append(first[kid])
            depth.append(deep)
            depths.append(deep)
    return depths, at, leaf


class _Minima:
    """Minima of any range of a row of numbers: blocks, minima to both sides inside a block, and
    minima of 1, 2, 4, ... neighbouring blocks."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        most = np.iinfo(values.dtype).max
        grid = np.append(values, np.full(-len(values) % self.BLOCK, most, dtype=values.dtype)).reshape(-1, self.BLOCK)
        self.values = grid.ravel()
        self.upto = np.minimum.accumulate(grid, axis=1).ravel()
        self.onward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [grid.min(axis=1)]
        while 2 ** len(self.levels) <= len(grid):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def between(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value from low to high, both included."""
        out = np.minimum(self.onward[low], self.upto[high])
        begin, many = low // self.BLOCK + 1, high // self.BLOCK - low // self.BLOCK - 1
        for level, table in enumerate(self.levels):
            of = np.flatnonzero((many >= 1 << level) & (many < 2 << level))
            if len(of):
                ends = np.minimum(table[begin[of]], table[begin[of] + many[of] - (1 << level)])
                out[of] = np.minimum(out[of], ends)
        inside = np.flatnonzero(many < 0)
        out[inside] = self.values[low[inside]]
        for step in range(1, self.BLOCK):
            place = np.minimum(low[inside] + step, high[inside])
            out[inside] = np.minimum(out[inside], self.values[place])
        return out


def _next_smaller(values: list[int]) -> list[int]:
    """For each place the next one with a smaller value; the length if there is none."""
    out, open_places = [len(values)] * len(values), []
    for place, value in enumerate(values):
        while open_places and values[open_places[-1]] > value:
            out[open_places.pop()] = place
        open_places.append(place)
    return out


def _runs(symbols: np.ndarray, stretch: np.ndarray, s: Settings) -> np.ndarray:
    """Rows (start, length, period) of all runs of ``symbols``; a run lies in one ``stretch``."""
    # Between stretches, and at the end, stand symbols that occur once.
    cut = np.append(np.flatnonzero(np.diff(stretch)) + 1, len(symbols))
    place = np.arange(len(symbols)) + stretch - stretch[0]
    text = np.empty(len(symbols) + len(cut), dtype=np.int64)
    text[place] = symbols
    marks = cut + np.arange(len(cut))
    text[marks] = int(symbols.max()) + 1 + np.arange(len(cut))

    own, size = marks[stretch - stretch[0]], np.diff(np.append(0, cut))[stretch - stretch[0]]
    tree = SuffixTree(text)
    found = []
    for order in (tree.rank, len(text) - tree.rank):
        period = np.array(_next_smaller(order.tolist()))[place] - place
        fits = (period * s.exponent <= size) & (place + period < own)
        found.append(np.stack([place[fits], period[fits]], axis=1))
    at, period = np.unique(np.concatenate(found), axis=0).T
    right = tree.agreement(at, at + period)
    del tree

    back = SuffixTree(np.append(text[:-1][::-1], text[-1]))
    left = np.zeros(len(at), dtype=np.int64)
    inner = np.flatnonzero(at > 0)
    mirrored = len(text) - 2 - (at[inner] - 1)
    left[inner] = back.agreement(mirrored, mirrored - period[inner])
    start, length = at - left, left + period + right
    keep = length >= np.maximum(s.least, s.exponent * period)
    start, length, period = start[keep], length[keep], period[keep]
    start -= np.searchsorted(marks, start)
    return np.unique(np.stack([start, period, length], axis=1), axis=0)[:, [0, 2, 1]]


def _remaining(words: np.ndarray, doc: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, their symbols and the stretch each belongs to."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbol = np.unique(words, return_inverse=True)[1]
    place, stretch = np.arange(len(words)), doc
    for _ in range(s.rounds):
        _, which, many = np.unique(stretch * (len(words) + 1) + symbol, return_inverse=True, return_counts=True)
        alive = many[which] >= s.exponent
        if alive.all() and len(alive):
            sizes = np.bincount(stretch)
            alive = sizes[stretch] >= s.least
            if alive.all():
                break
        place, symbol, stretch = place[alive], symbol[alive], stretch[alive]
        if not len(place):
            break
        new = np.append(False, (np.diff(place) != 1) | (np.diff(stretch) != 0))
        stretch = np.cumsum(new)
        sizes = np.bincount(stretch)
        alive = sizes[stretch] >= s.least
        place, symbol, stretch = place[alive], symbol[alive], stretch[alive]
        if not len(place):
            break
    if len(stretch):
        stretch = np.cumsum(np.append(False, np.diff(stretch) != 0))
    return place, symbol, stretch


def runs(words: np.ndarray, before: np.ndarray, s: Settings = Settings()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (in it), length and period of every run; ``before`` counts the words before each document."""
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    place, symbol, stretch = _remaining(words, doc, s)
    if not len(place):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    found = _runs(symbol, stretch, s)
    first = place[found[:, 0]]
    return doc[first], first - before[doc[first]], found[:, 1], found[:, 2]


def collapsed(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, runs (start, length and period, by start, then period) and collapsed (the words but
    those of a run after its first period, joined by one space) of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text", s.slice_bytes):
                starts, ends, before = common.word_spans(data, offsets)
                doc, start, length, period = runs(common.word_hashes(data, starts, ends, lower=False), before, s)
                depth = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(depth, before[doc] + start + period, 1)
                np.add.at(depth, before[doc] + start + length, -1)
                stays = np.cumsum(depth[:-1]) == 0
                order = np.lexsort((period, start, doc))
                rows = np.searchsorted(doc[order], np.arange(len(part) + 1))
                with_runs = set(doc.tolist())
                raw, texts = data.tobytes(), []
                for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                    words = raw[a:b].split()  # white space of bytes is that of WORD
                    if k in with_runs:
                        words = compress(words, stays[before[k] : before[k + 1]].tolist())
                    texts.append(b" ".join(words))
                values = pa.StructArray.from_arrays([pa.array(x[order]) for x in (start, length, period)], fields=list(run))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(before)), pa.ListArray.from_arrays(pa.array(rows, pa.int32()), values), pa.array(texts, pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return common.needed(docs, "doc_id", "text").mapInArrow(find, schema)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, in which every tenth document by its hash repeats a stretch of its words to the end."""
    text, hashed = F.coalesce(F.col("text"), F.lit("")), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    chosen = common.needed(docs, "doc_id", "text").withColumn("_g", F.floor(hashed / 10)).withColumn("_w", F.when(hashed % 10 == 0, words))
    n, g = F.size("_w"), F.col("_g")
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    stretch = F.slice("_w", a + 1, p)
    copies = F.ceil((n - a) / p).cast("int")
    repeated = F.slice(F.flatten(F.array_repeat(stretch, copies)), F.lit(1), n - a)
    plain = F.coalesce(n, F.lit(0)) <= 0
    changed = F.array_join(F.concat(F.slice("_w", F.lit(1), a), repeated), " ")
    return chosen.select("doc_id", F.when(plain, F.col("text")).otherwise(changed).alias("text"))


def _strongest(found: Column) -> Column:
    """The run with the greatest length / period; of equals the first."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    greater = lambda best, one: best.isNull() | (one["length"] * best["period"] > best["length"] * one["period"])
    return F.aggregate(found, none, lambda best, one: F.when(greater(best, one), one).otherwise(best))


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    found = collapsed(docs, s).withColumn("best", _strongest(F.col("runs")))
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: A search over all periods: places whose word stands again q words on, in islands, per document and q.
SQL = r"""
WITH table8 AS MATERIALIZED (
  SELECT LIST(c ORDER BY i) AS t FROM (
    SELECT i, LIST_REDUCE([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM RANGE(0, 256) AS r(i))
), hashed AS (
  SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(COALESCE(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295::UBIGINT, LIST_REDUCE(LIST_PREPEND(4294967295::UBIGINT, LIST_TRANSFORM(STRING_SPLIT(doc_id::VARCHAR, ''), lambda x: UNICODE(x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1]))) AS h FROM documents, table8
), cut AS (
  SELECT doc_id, w, h, LEN(w) AS n, (h // 10 % GREATEST(LEN(w), 1))::BIGINT AS a, (h // 10 % 8)::BIGINT AS g8 FROM hashed
), worded AS MATERIALIZED (
  SELECT doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN LIST_CONCAT(w[:a], LIST_TRANSFORM(RANGE(0, n - a), lambda k: w[a + k % (1 + (n - a) // (3 + g8)) + 1])) ELSE w END AS w FROM cut
), places AS MATERIALIZED (
  SELECT doc_id, LEN(w) AS n, UNNEST(w) AS word, UNNEST(RANGE(0, LEN(w))) AS i FROM worded
), pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM places x JOIN places y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND (y.i - x.i) * 4 <= x.n
), islands AS (
  SELECT doc_id, q, MIN(i) AS start, COUNT(*) + q AS length FROM (SELECT doc_id, q, i, i - ROW_NUMBER() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs)
  GROUP BY doc_id, q, island HAVING COUNT(*) + q >= GREATEST(6, 4 * q)
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, MIN(q) AS q FROM islands GROUP BY doc_id, start, length
), gone AS (
  SELECT doc_id, LIST(DISTINCT i) AS spots FROM (SELECT doc_id, UNNEST(RANGE(start + q, start + length)) AS i FROM runs) GROUP BY doc_id
), best AS (
  SELECT doc_id, COUNT(*) AS n_runs, SHA256(STRING_AGG(start || ',' || length || ',' || q || CHR(10), '' ORDER BY start, q)) AS digest FROM runs GROUP BY doc_id
), first_of AS (
  SELECT r.doc_id, r.start, r.length, r.q FROM runs r
  WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.doc_id = r.doc_id AND (o.length * r.q > r.length * o.q OR (o.length * r.q = r.length * o.q AND (o.start, o.q) < (r.start, r.q))))
)
SELECT d.doc_id, COALESCE(n_runs, 0)::BIGINT AS n_runs, f.start::BIGINT AS start, f.length::BIGINT AS length, f.q::BIGINT AS period,
  (1000 * f.length // f.q)::BIGINT AS exponent_milli, COALESCE(digest, SHA256('')) AS runs_sha256,
  SHA256(COALESCE(ARRAY_TO_STRING(CASE WHEN spots IS NULL THEN w ELSE LIST_FILTER(w, lambda x, i: NOT LIST_CONTAINS(spots, i - 1)) END, ' '), '')) AS collapsed_sha256
FROM worded d LEFT JOIN best b ON d.doc_id = b.doc_id LEFT JOIN first_of f ON d.doc_id = f.doc_id LEFT JOIN gone g ON d.doc_id = g.doc_id
"""
