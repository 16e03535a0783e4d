"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of L characters is found in a text where some stretch of the text is within
``floor(edit_share * L)`` character edits of it. Texts and items are compared with A-Z lower-cased
and every white-space character read as a space, so positions stay those of the original.

A stretch within e edits keeps at least ``L + 1 - q - q * e`` of the item's q-grams, and as an edit
shifts what follows by one at most, those lie on diagonals (place in text minus place in item) that
span no more than e. Every shared q-gram is counted in the band of its diagonal; two neighbouring
bands, each wider than any e, overlap so that one such pair holds them all. Pairs of bands that
reach the item's bound are verified by an alignment over the diagonals of the pair (and e more on
either side). No hit is lost: the filter only drops what cannot be within the edits.

The items are a small table: they go to the tasks in portions of at most ``portion_bytes``, one
pass over the documents for each portion, so what is sent has a fixed size. Documents are read
once per portion and never shuffled; long texts are searched in overlapping pieces.

Items shorter than ``min_chars`` are found where they stand unchanged as whole words: no letter or digit
touches a letter or digit at either end.

Defined cases: null or empty texts hold nothing. Items that are null, empty or white space hold nothing to
find and are ignored; items that repeat are each reported. Repeated documents are each
reported. A null doc_id is reported as such. Other columns are ignored by ``leaks`` and kept by
``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect.llm.common import needed


@dataclass(frozen=True)
class Settings:
    q: int = 8
    edit_share: float = 0.08
    min_chars: int = 40
    piece_chars: int = 1 << 16
    portion_bytes: int = 16 << 20
    hash_bits: int = 20


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FOLD = np.arange(0x3001, dtype=np.uint32)
_FOLD[65:91] += 32
for _space in (*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _FOLD[_space] = 32


def characters(text: str) -> np.ndarray:
    """Code points, A-Z lower-cased, white space as a space."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(points) and points.max() > 0x3000:
        return np.where(points <= 0x3000, _FOLD[np.minimum(points, 0x3000)], points)
    return _FOLD[points]


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """The q-gram at each place as a number; q-grams of up to 8 characters that fold to bytes."""
    narrow = (points ^ (points >> np.uint32(8)) * np.uint32(167)).astype(np.uint8)
    n = len(narrow) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    padded = np.concatenate([narrow, np.zeros(8, np.uint8)])
    wide = np.ndarray((n,), dtype="<u8", buffer=padded.data, strides=(1,))
    return wide & np.uint64((1 << (8 * q)) - 1) if q < 8 else wide.copy()


def _place(item: np.ndarray, text: np.ndarray) -> int:
    """Where ``item`` stands in ``text`` first; -1 if nowhere."""
    wanted, within = item.astype(np.uint32).tobytes(), text.astype(np.uint32).tobytes()
    at = within.find(wanted)
    while at % 4 and at >= 0:
        at = within.find(wanted, at + 1)
    return at // 4 if at >= 0 else -1


def best_alignment(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the stretch of ``text`` nearest to ``item``: the fewest edits, then the
    earliest end, then the latest start; None beyond ``most`` edits."""

    def last_row(pattern: np.ndarray, within: np.ndarray, free: bool) -> np.ndarray:
        steps = np.arange(len(within) + 1)
        row = np.zeros(len(within) + 1, dtype=np.int64) if free else steps.copy()
        for k, c in enumerate(pattern):
            new = np.empty_like(row)
            new[0] = k + 1
            np.minimum(row[:-1] + (within != c), row[1:] + 1, out=new[1:])
            row = np.minimum.accumulate(new - steps) + steps
        return row

    unchanged = _place(item, text)
    if unchanged >= 0:
        return 0, unchanged, unchanged + len(item)
    if not most:
        return None
    ends = last_row(item, text, True)
    edits = int(ends.min())
    if edits > most:
        return None
    end = int(ends.argmin())
    reach = text[max(0, end - len(item) - edits) : end][::-1]
    starts = last_row(item[::-1], reach, False)
    return edits, end - int(np.flatnonzero(starts == edits)[0]), end


class _WholeWords:
    """Short items, found unchanged where no letter or digit goes on at their ends."""

    def __init__(self, items: list[tuple[int, str]], q: int):
        self.items = [(k, characters(t.strip())) for k, t in items]
        self.by_length: dict[int, dict[int, list[int]]] = {}
        for place, (_, item) in enumerate(self.items):
            n = min(len(item), q)
            self.by_length.setdefault(n, {}).setdefault(int(_grams(item, n)[0]), []).append(place)
        self.keys = {n: np.array(sorted(found), dtype=np.uint64) for n, found in self.by_length.items()}

    def find(self, points: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item's number, 0, start, end) of the first place of each item that is found."""
        found: dict[int, tuple[int, int]] = {}

        def inside(at: int) -> bool:
            return 0 < at < len(points) and chr(points[at - 1]).isalnum() and chr(points[at]).isalnum()

        for n, keys in self.keys.items():
            grams = _grams(points, n)
            slot = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
            for at in np.flatnonzero(keys[slot] == grams).tolist():
                for place in self.by_length[n][int(grams[at])]:
                    number, item = self.items[place]
                    end = at + len(item)
                    if number not in found and end <= len(points) and (points[at:end] == item).all() and not inside(at) and not inside(end):
                        found[number] = (at, end)
        return [(k, 0, *span) for k, span in found.items()]


class Matcher:
    """The items' q-grams, and the search of one text for all of them."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings):
        if not 1 <= settings.q <= 8 or settings.q * settings.edit_share >= 1:
            raise ValueError("q must be 1 to 8 and q * edit_share below 1")
        self.s = settings
        items = [(i, t) for i, t in items if t is not None and t.strip()]
        self.short = _WholeWords([(k, t) for k, (_, t) in enumerate(items) if len(t) < settings.min_chars], settings.q)
        self.numbers = [k for k, (_, t) in enumerate(items) if len(t) >= settings.min_chars]
        self.ids = [i for i, _ in items]
        items = [items[k] for k in self.numbers]
        self.items = [characters(t) for _, t in items]
        self.edits = np.array([int(settings.edit_share * len(p)) for p in self.items], dtype=np.int64)
        sizes = np.array([len(p) for p in self.items], dtype=np.int64)
        self.bound = np.maximum(1, sizes + 1 - settings.q - settings.q * self.edits)
        self.band = int(self.edits.max()) + 1 if len(items) else 1
        self.longest = int(sizes.max()) if len(items) else 0
        grams = [_grams(p, settings.q) for p in self.items]
        count = np.array([len(g) for g in grams], dtype=np.int64)
        every = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.item = np.repeat(np.arange(len(items)), count)[order]
        self.place = np.concatenate([np.arange(n) for n in count])[order] if len(items) else np.zeros(0, np.int64)
        self.seen = np.zeros(1 << settings.hash_bits, dtype=bool)
        self.seen[self._hash(self.keys)] = True

    def _hash(self, grams: np.ndarray) -> np.ndarray:
        return (grams * _MULTIPLIER) >> np.uint64(64 - self.s.hash_bits)

    def _suspects(self, points: np.ndarray) -> np.ndarray:
        """(item, band) pairs, as rows, whose count of shared q-grams reaches the item's bound."""
        grams = _grams(points, self.s.q)
        at = np.flatnonzero(self.seen[self._hash(grams)])
        slot = np.searchsorted(self.keys, grams[at])
        slot[slot == len(self.keys)] = 0
        real = self.keys[slot] == grams[at]
        at, slot = at[real], slot[real]
        if len(at) < self.bound.min(initial=1):
            return np.zeros((0, 2), np.int64)
        bands = (len(points) + self.longest) // self.band + 2
        many = self.first[slot + 1] - self.first[slot]
        begin, reach = 0, np.cumsum(many)
        cells, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while begin < len(at):  # a portion of the shared q-grams at a time; only cells that hold one are kept
            stop = max(begin + 1, int(np.searchsorted(reach, (reach[begin - 1] if begin else 0) + (1 << 20), side="right")))
            n = many[begin:stop]
            entry = np.repeat(self.first[slot[begin:stop]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            diagonal = np.repeat(at[begin:stop], n) - self.place[entry] + self.longest
            new, seen = np.unique(self.item[entry] * bands + diagonal // self.band, return_counts=True)
            if len(cells):
                both, where = np.unique(np.concatenate([cells, new]), return_inverse=True)
                new, seen = both, np.bincount(where, weights=np.concatenate([counts, seen])).astype(np.int64)
            cells, counts = new, seen
            begin = stop
        # Of two neighbours that reach the bound together one holds half of it.
        strong = cells[2 * counts >= self.bound[cells // bands]]
        if not len(strong):
            return np.zeros((0, 2), np.int64)
        lower = np.unique(np.concatenate([strong, strong[strong % bands > 0] - 1]))
        lower = lower[lower % bands < bands - 1]

        def count(cell: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(cells, cell), len(cells) - 1)
            return np.where(cells[at] == cell, counts[at], 0)

        enough = count(lower) + count(lower + 1) >= self.bound[lower // bands]
        return np.stack([lower[enough] // bands, lower[enough] % bands], axis=1)

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item's number, edits, start, end) of the best stretch for every item that is found."""
        points = characters(text)
        out = self.short.find(points)
        if not self.items or len(text) < self.s.q:
            return sorted(out)
        best: dict[int, tuple[int, int, int]] = {}
        overlap = self.longest + 3 * self.band
        for begin in range(0, max(1, len(points) - overlap), self.s.piece_chars):
            piece = points[begin : begin + self.s.piece_chars + overlap]
            for k, band in self._suspects(piece).tolist():
                item, most = self.items[k], int(self.edits[k])
                first = max(0, band * self.band - self.longest - most)
                last = (band + 2) * self.band - self.longest + len(item) + most
                if (got := best_alignment(item, piece[first : max(0, last)], most)) is not None:
                    found = (got[0], begin + first + got[1], begin + first + got[2])
                    best[k] = min(best.get(k, found), found)
        return sorted(out + [(self.numbers[k], *found) for k, found in best.items()])


def portions(benchmark: DataFrame, settings: Settings) -> Iterator[Matcher]:
    """The benchmark's items, so many at a time that a portion has about ``portion_bytes``."""
    rows = needed(benchmark, "item_id", "text").where(F.length(F.trim("text")) > 0)
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // settings.portion_bytes))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Matcher([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], settings)


def leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, edits, start and end (characters) for each item that a document holds."""
    kind, item_kind = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    docs = needed(docs, "doc_id", "text")
    out = None
    for matcher in portions(benchmark, settings):

        def search(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, matcher.ids[k], edits, start, end)
                    for doc, text in zip(batch.column(0), batch.column(1))
                    for k, edits, start, end in matcher.find(text.as_py() or "")
                ]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([d.as_py() for d in columns[0]], batch.schema.field(0).type),
                        pa.array(columns[1], pa.int64() if item_kind == "bigint" else None),
                        *[pa.array(c, pa.int32()) for c in columns[2:]],
                    ],
                    names=["doc_id", "item_id", "edits", "start", "end"],
                )

        part = docs.mapInArrow(search, f"doc_id {kind}, item_id {item_kind}, edits int, start int, end int")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns kept."""
    for matcher in portions(benchmark, settings):

        def keep(batches: Iterator[pa.RecordBatch], matcher: Matcher = matcher) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                yield batch.filter(pa.array([not matcher.find(t.as_py() or "") for t in texts], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
