"""Fill-in-the-middle texts by rotating blocks in place.

A text is scanned into tokens, runs of A-Z and a-z or single other code points. Two cuts drawn from a
hash of the document's id split it into prefix, middle and suffix. The three sentinels are inserted
into the text's bytearray, ``<P>prefix<M>middle<S>suffix``, and its blocks exchanged: a rotation
reverses each of two neighbouring blocks and then both together. One rotation gives the form psm,
``<P>prefix<S>suffix<M>middle``; a second one spm, ``<S>suffix<P>prefix<M>middle``. ``restored`` finds
the sentinels, inverts the rotations and takes the sentinels out; it needs the output and the form only.

A text that holds a sentinel stays plain, so a sentinel in an output is one that was inserted (one
cannot arise across a seam either, as it begins with ``<`` and ends with ``>``).

Rows are independent: one scan, no shuffle. Cuts are found for whole slices of a batch at once.

Defined cases: null and empty texts are plain and give the empty text. A null doc_id is hashed as the
empty id. Repeated rows get the same cuts. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from paneleffect.llm import common

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


@dataclass(frozen=True)
class Settings:
    salt: str = "1"
    transformed: int = 90  # of 100 texts
    suffix_first: int = 20  # of 100 transformed texts


def _draw(doc_id: Column, k: int, s: Settings) -> Column:
    """The k-th 32-bit number of the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{s.salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")


def _form(text: Column, doc_id: Column, s: Settings) -> Column:
    holds = F.contains(text, F.lit(PREFIX.decode())) | F.contains(text, F.lit(SUFFIX.decode())) | F.contains(text, F.lit(MIDDLE.decode()))
    plain = (text == "") | holds | (_draw(doc_id, 2, s) % 100 >= s.transformed)
    return F.when(plain, PLAIN).when(_draw(doc_id, 3, s) % 100 < s.suffix_first, SPM).otherwise(PSM)


def rotate(buffer: bytearray, first: int, middle: int, end: int) -> None:
    """Exchange buffer[first:middle] and buffer[middle:end] by three reversals."""
    for a, b in ((first, middle), (middle, end), (first, end)):
        buffer[a:b] = buffer[a:b][::-1]


def arranged(text: bytes, low: int, high: int, form: str) -> bytearray:
    """The text with sentinels at its cuts, blocks in the order of the form."""
    buffer = bytearray(text)
    if form == PLAIN:
        return buffer
    buffer[high:high] = SUFFIX
    buffer[low:low] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix, end = low + len(PREFIX), high + len(PREFIX) + len(MIDDLE), len(buffer)
    rotate(buffer, middle, suffix, end)
    if form == SPM:
        rotate(buffer, 0, middle, middle + end - suffix)
    return buffer


def rebuilt(output: bytes, form: str) -> bytearray:
    """The text that ``arranged`` was given."""
    buffer = bytearray(output)
    if form == PLAIN:
        return buffer
    middle = buffer.index(MIDDLE)
    if form == SPM:
        rotate(buffer, 0, buffer.index(PREFIX), middle)
    suffix, end = buffer.index(SUFFIX), len(buffer)
    rotate(buffer, suffix, middle, end)
    suffix, middle = suffix + end - middle, suffix
    del buffer[suffix : suffix + len(SUFFIX)]
    del buffer[middle : middle + len(MIDDLE)]
    del buffer[: len(PREFIX)]
    return buffer


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the tokens (and the end), for every document the tokens before it, and for every
    byte the code points before it."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    goes_on = np.zeros(len(data), dtype=bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(point & ~goes_on)
    points = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(point, out=points[1:])
    return np.append(starts, len(data)), np.searchsorted(starts, offsets), points


def infilled(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars (code points; null if plain) and output of every row."""
    kind = dict(docs.dtypes)["doc_id"]
    text, doc_id = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id")
    rows = common.needed(docs, "doc_id", "text").select(
        "doc_id", text.alias("text"), _form(text, doc_id, s).alias("form"), _draw(doc_id, 0, s).alias("h1"), _draw(doc_id, 1, s).alias("h2")
    )

    def rearrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in common.slices(batch, "text"):
                starts, before, points = _tokens(data, offsets)
                n = np.diff(before)
                one, two = (part.column(k).to_numpy() % (n + 1) for k in (3, 4))
                low, high = (starts[before[:-1] + cut] for cut in (np.minimum(one, two), np.maximum(one, two)))
                begin, forms, raw = offsets[:-1], part.column(2).to_pylist(), data.tobytes()
                outputs = [
                    bytes(arranged(raw[a:b], x - a, y - a, form))
                    for a, b, x, y, form in zip(begin.tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), forms)
                ]
                plain = np.array([form == PLAIN for form in forms])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(n, pa.int64()),
                        part.column(2),
                        pa.array(points[low] - points[begin], pa.int64(), mask=plain),
                        pa.array(points[high] - points[low], pa.int64(), mask=plain),
                        pa.array(outputs, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(rearrange, schema)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs`` (with columns form and output) with ``restored``, the text each came from."""
    schema = StructType([*outputs.schema.fields]).add("restored", StringType())

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            output, form = (batch.column(batch.schema.get_field_index(c)) for c in ("output", "form"))
            texts = [bytes(rebuilt(text.encode(), name)) for text, name in zip(output.to_pylist(), form.to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*batch.schema.names, "restored"])

    return outputs.mapInArrow(undo, schema)


def digest(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    return restored(infilled(docs, s)).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


SQL = """
WITH drawn AS (
  SELECT doc_id, COALESCE(text, '') AS text, SHA256('1:' || COALESCE(doc_id::VARCHAR, '')) AS h, REGEXP_EXTRACT_ALL(COALESCE(text, ''), '[A-Za-z]+|[^A-Za-z]') AS t FROM documents
), numbers AS (
  SELECT doc_id, text, t, LEN(t) AS n, ('0x' || h[1:8])::UBIGINT % (LEN(t) + 1) AS a, ('0x' || h[9:16])::UBIGINT % (LEN(t) + 1) AS b,
    ('0x' || h[17:24])::UBIGINT % 100 AS c, ('0x' || h[25:32])::UBIGINT % 100 AS d FROM drawn
), cut AS (
  SELECT doc_id, text, n, ARRAY_TO_STRING(t[:LEAST(a, b)], '') AS p, ARRAY_TO_STRING(t[LEAST(a, b) + 1:GREATEST(a, b)], '') AS m, ARRAY_TO_STRING(t[GREATEST(a, b) + 1:], '') AS s,
    CASE WHEN text = '' OR CONTAINS(text, '<P>') OR CONTAINS(text, '<S>') OR CONTAINS(text, '<M>') OR c >= 90 THEN 'plain' WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN LENGTH(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN LENGTH(m) END::BIGINT AS middle_chars,
  SHA256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  SHA256(text) AS restored_sha256 FROM cut
"""
