"""Line de-duplication within one word edit, by a deletion-neighbourhood join.

A line is a piece of a text between line feeds; its words are lower-cased (A-Z). Two lines are near
when one inserted, deleted or changed word at most tells them apart. A line of ``min_words`` words
or more is removed when an earlier line of the corpus, by (doc_id, line number), is near it; all is
judged on the input, so the result does not depend on the order of work. Shorter lines are removed when an
earlier line has the same words, or stay where ``short`` is not asked for; lines without a word always stay.
The pipeline, ``digest`` and its SQL ask for ``short``.

The work:

1. Every line becomes a hash of its words, with hashes of its first and its last half. One edit
   leaves the first or the last half of two near lines equal, so distinct lines without a half in
   common with another distinct line are done (no near pair is lost).
2. Each distinct line that is left emits, as hashed keys, all its variants: the whole line, and the
   line without its k-th word for every k.
3. Lines equal in a variant at the same place differ in that one word, all of them: each is joined
   to the group's earliest line only, never to all others. A whole line equal to another's variant
   is joined to it.
4. Joined lines are compared word by word (equal beginning and end cover all but one word), then
   each line takes the earliest place among its own and its neighbours'.

Defined cases: a null text has no lines and stays null; an empty text is one empty line. Rows that
repeat a doc_id count as one place: their equal lines, and lines repeated in both, are judged by
line number alone and share one fate. Rows with a null doc_id are left as they are. Other columns
are ignored by ``removed_lines`` and kept by ``without_repeats``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect.llm import common

MIN_WORDS = 5
_BASE = np.uint64(0xA24BAED4963EE407)
_BACK = np.uint64(pow(0xA24BAED4963EE407, -1, 1 << 64))


class _Lines:
    """The lines of a slice of documents as spans of word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        feeds = np.flatnonzero(data == 10)
        self.starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
        doc_of = np.searchsorted(feeds, offsets[:-1])
        per_doc = np.append(doc_of[1:], len(feeds)) - doc_of + 1
        self.doc = np.repeat(np.arange(len(per_doc)), per_doc)
        # An empty document begins where the next one does: its line comes first in both orders.
        self.ends = np.append(self.starts[1:], len(data))
        self.number = np.arange(len(self.starts)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        word_starts, word_ends, _ = common.word_spans(data, offsets)
        self.words = common.word_hashes(data, word_starts, word_ends, lower=True)
        self.first = np.searchsorted(word_starts, self.starts)
        self.size = np.append(self.first[1:], len(word_starts)) - self.first
        n = len(self.words)
        self.back = common._powers(_BACK, n + 2)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.words * common._powers(_BASE, n), out=self.sums[1:])

    def hashes(self, start: np.ndarray, size: np.ndarray, salt: int) -> np.ndarray:
        raw = (self.sums[start + size] - self.sums[start]) * self.back[start]
        return common.mixed(raw + np.uint64(salt)) + size.astype(np.uint64)

    def whole(self, lines: np.ndarray) -> np.ndarray:
        return self.hashes(self.first[lines], self.size[lines], 0)


def _narrow_lines(docs: DataFrame, min_words: int, short: bool) -> DataFrame:
    """doc_id, line number, hash and half keys of every line with enough words; with ``short`` also of
    shorter lines with a word, whose half keys are null."""
    schema = pa.schema([("doc_id", pa.int64()), ("line_no", pa.int32()), ("h", pa.int64())] + [(f"k{i}", pa.int64()) for i in range(4)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                ids = part.column(0).to_numpy(zero_copy_only=False)
                lines = _Lines(data, offsets)
                use = np.flatnonzero(lines.size >= (1 if short else min_words))
                first, size = lines.first[use], lines.size[use]
                keys = []
                for half in (size // 2, (size - 1) // 2):
                    keys += [lines.hashes(first, half, 1), lines.hashes(first + size - half, half, 2)]
                yield common.records(
                    schema, doc_id=ids[lines.doc[use]], line_no=lines.number[use], h=common.as_long(lines.whole(use)),
                    **{f"k{i}": pa.array(common.as_long(k), mask=size < min_words) for i, k in enumerate(keys)},
                )

    return docs.mapInArrow(scan, "doc_id long, line_no int, h long, k0 long, k1 long, k2 long, k3 long")


def _suspect_lines(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The words of the wanted lines, taken from the document each occurs in first."""
    per_doc = wanted.groupBy("d0").agg(F.collect_list(F.struct("h", "l0")).alias("_wanted"))
    joined = docs.join(per_doc, docs["doc_id"] == per_doc["d0"]).select("d0", "text", "_wanted")
    schema = pa.schema([("h", pa.int64()), ("d0", pa.int64()), ("l0", pa.int32()), ("line", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                raw, out, every = data.tobytes(), ([], [], [], []), _Lines(data, offsets)
                first = np.searchsorted(every.doc, np.arange(len(part)))
                hashes = common.as_long(every.whole(np.arange(len(every.doc))))
                for row, (doc, wants) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                    lines = raw[offsets[row] : offsets[row + 1]].split(b"\n")
                    for w in wants:
                        # Another row of the same id may have another line there.
                        if w["l0"] < len(lines) and hashes[first[row] + w["l0"]] == w["h"]:
                            for column, value in zip(out, (w["h"], doc, w["l0"], b" ".join(lines[w["l0"]].lower().split()))):
                                column.append(value)
                yield common.records(schema, h=out[0], d0=out[1], l0=out[2], line=out[3])

    return joined.mapInArrow(cut, "h long, d0 long, l0 int, line binary").dropDuplicates(["h"])


def _variants(suspects: DataFrame) -> DataFrame:
    """Every suspect line's hashed variants: place -1 for the whole line, k for the line without word k."""
    schema = pa.schema([("v", pa.int64()), ("place", pa.int32()), ("h", pa.int64()), ("d0", pa.int64()), ("l0", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(3).cast(pa.string(), safe=False)
            whole = pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(3)], text], names=["h", "d0", "l0", "text"])
            for part, data, offsets in common.slices(whole, "text"):
                lines = _Lines(data, offsets)
                size, first = lines.size, lines.first
                line = np.repeat(np.arange(len(size)), size)
                at = np.arange(len(lines.words))
                before = lines.sums[at] - lines.sums[first[line]]
                after = (lines.sums[(first + size)[line]] - lines.sums[at + 1]) * _BACK
                raw = (before + after) * lines.back[first[line]]
                less = common.mixed(raw) + (size[line] - 1).astype(np.uint64)
                all_lines = np.arange(len(size))
                row = np.concatenate([all_lines, line])
                yield common.records(
                    schema, v=common.as_long(np.concatenate([lines.whole(all_lines), less])),
                    place=np.concatenate([np.full(len(size), -1), at - first[line]]),
                    h=part.column(0).to_numpy()[row], d0=part.column(1).to_numpy()[row], l0=part.column(2).to_numpy()[row],
                )

    return suspects.mapInArrow(emit, "v long, place int, h long, d0 long, l0 int")


def within_one_word(a: bytes, b: bytes) -> bool:
    """Edit distance of one word at most: equal beginning and end cover all but one word."""
    x, y = a.split(), b.split()
    if abs(len(x) - len(y)) > 1:
        return False
    short, long = min(len(x), len(y)), max(len(x), len(y))
    head = next((k for k in range(short) if x[k] != y[k]), short)
    tail = next((k for k in range(short - head) if x[-1 - k] != y[-1 - k]), short - head)
    return head + tail >= long - 1


def _verified(pairs: DataFrame, suspects: DataFrame) -> DataFrame:
    """Pairs (h, other) whose words are compared; h with the place of the other line."""
    own = suspects.select("h", F.col("line").alias("_own"))
    other = suspects.select(F.col("h").alias("other"), "d0", "l0", F.col("line").alias("_other"))
    joined = pairs.join(own, "h").join(other, "other").select("h", "d0", "l0", "_own", "_other")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [within_one_word(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield batch.select([0, 1, 2]).filter(pa.array(near, pa.bool_()))

    return joined.mapInArrow(check, "h long, d0 long, l0 int")


def removed_lines(docs: DataFrame, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """doc_id, line_no (from 0) of every line that has an earlier near line; with ``short`` also of lines
    under ``min_words`` words that have an earlier equal line."""
    if min_words < 2:
        raise ValueError("min_words must be at least 2")
    docs = common.needed(docs, "doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    lines = common.stage(_narrow_lines(docs, min_words, short), "lines")

    # One row per distinct line with its first place; ``doc_id`` decides, then the line number.
    keys = [F.min(f"k{i}").alias(f"k{i}") for i in range(4)]
    in_doc = lines.groupBy("h", "doc_id").agg(F.min("line_no").alias("l"), *keys)
    firsts = in_doc.groupBy("h").agg(F.min("doc_id").alias("d0"), F.min_by("l", "doc_id").alias("l0"), *keys)
    firsts = common.stage(firsts, "first-lines")

    # Short lines have no half keys: none is compared within one edit.
    halves = firsts.where(F.col("k0").isNotNull()).select("h", F.explode(F.array_distinct(F.array(*[f"k{i}" for i in range(4)]))).alias("k"))
    shared = halves.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("k")
    wanted = halves.join(shared, "k", "left_semi").select("h").distinct()
    wanted = firsts.select("h", "d0", "l0").join(wanted, "h", "left_semi")

    suspects = common.stage(_suspect_lines(docs, wanted), "suspect-lines")
    variants = common.stage(_variants(suspects), "line-variants")
    less = variants.where("place >= 0")
    earliest = less.groupBy("v", "place").agg(
        F.min(F.struct("d0", "l0", "h")).alias("e"), F.min("h").alias("a"), F.max("h").alias("b")
    )
    earliest = earliest.where("a <> b").select("v", "place", F.col("e.h").alias("other"))
    changed = less.join(earliest, ["v", "place"]).where("h <> other").select("h", "other")
    whole = variants.where("place < 0").select("v", F.col("h").alias("other"))
    longer = less.join(whole, "v").select("h", "other").where("h <> other")
    shorter = longer.select(F.col("other").alias("h"), F.col("h").alias("other"))
    pairs = changed.unionByName(longer).unionByName(shorter).distinct()
    near = common.stage(_verified(pairs, suspects), "near-lines")

    place = F.struct("d0", "l0")
    best = firsts.select("h", "d0", "l0").unionByName(near).groupBy("h").agg(F.min(place).alias("p"))
    best = best.select("h", "p.*")
    late = (F.col("d0") < F.col("doc_id")) | ((F.col("d0") == F.col("doc_id")) & (F.col("l0") < F.col("line_no")))
    return lines.join(best, "h").where(late).select("doc_id", "line_no")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``, and ``_n_lines`` and ``_n_removed`` added."""
    gone = removed_lines(docs, min_words, short).groupBy(F.col("doc_id").alias("_gone_of")).agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(gone, F.col("doc_id").cast("long") == F.col("_gone_of"), "left")
    pieces = F.split(F.col("text"), "\n", -1)
    kept = F.array_join(F.filter(pieces, lambda x, i: ~F.array_contains("_gone", i)), "\n")
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept)
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(pieces), F.lit(0)).cast("long").alias("_n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("_n_removed"),
    )


def reduced(docs: DataFrame, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """``docs`` without the removed lines; a document with no word left after a removal goes."""
    out = without_repeats(docs, min_words, short)
    empty = (F.col("_n_removed") > 0) & ~F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    return out.where(~F.coalesce(empty, F.lit(False))).drop("_n_lines", "_n_removed")


def digest(docs: DataFrame) -> DataFrame:
    out = without_repeats(common.needed(docs, "doc_id", "text"), short=True)
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.col("_n_lines")).alias("n_lines"),
        F.greatest("_n_removed", F.lit(0)).alias("n_removed"),
        F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"),
    )


SQL = f"""
WITH pieces AS (
  SELECT doc_id, i - 1 AS line_no, p[i] AS line
  FROM (SELECT doc_id, p, UNNEST(RANGE(1, LEN(p) + 1)) AS i FROM (SELECT doc_id, STRING_SPLIT(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))
), worded AS (
  SELECT *, LIST_FILTER(STRING_SPLIT_REGEX(LOWER(line), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM pieces
), lines AS (
  SELECT doc_id, line_no, w, ARRAY_TO_STRING(w, ' ') AS h FROM worded WHERE LEN(w) >= 1
), every_first AS (
  SELECT h, ANY_VALUE(w) AS w, MIN({{'d': doc_id, 'l': line_no}}) AS p FROM lines GROUP BY h
), firsts AS (
  SELECT * FROM every_first WHERE LEN(w) >= {MIN_WORDS}
), variants AS MATERIALIZED (
  SELECT h, p, k, ARRAY_TO_STRING(LIST_CONCAT(w[1:k - 1], w[k + 1:LEN(w)]), ' ') AS v
  FROM (SELECT h, w, p, UNNEST(RANGE(1, LEN(w) + 1)) AS k FROM firsts)
), earliest AS (
  SELECT v, k, MIN(p) AS p FROM variants GROUP BY v, k
), near AS (
  SELECT variants.h, earliest.p FROM variants JOIN earliest USING (v, k)
  UNION ALL SELECT variants.h, firsts.p FROM variants JOIN firsts ON variants.v = firsts.h
  UNION ALL SELECT firsts.h, variants.p FROM variants JOIN firsts ON variants.v = firsts.h
  UNION ALL SELECT h, p FROM every_first
), best AS (
  SELECT h, MIN(p) AS p FROM near GROUP BY h
), gone AS (
  SELECT l.doc_id, l.line_no FROM lines l JOIN best b USING (h) WHERE b.p < {{'d': l.doc_id, 'l': l.line_no}}
), kept AS (
  SELECT pieces.doc_id, COUNT(*) AS n_lines, COUNT(gone.line_no) AS n_removed,
    STRING_AGG(line, chr(10) ORDER BY pieces.line_no) FILTER (gone.line_no IS NULL) AS text
  FROM pieces LEFT JOIN gone ON pieces.doc_id = gone.doc_id AND pieces.line_no = gone.line_no GROUP BY pieces.doc_id
)
SELECT d.doc_id, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN SHA256(COALESCE(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
