"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is lower-cased; ASCII characters that are not letters become spaces; its subwords are the
runs of 2 to 4 bytes inside words, a space on either side counting as the word's edge. Every
subword is hashed to a row of an embedding table, the rows of a text are averaged, and a linear
softmax gives the languages' probabilities. Embeddings and weights are trained together by
stochastic gradient descent in numpy on a bounded sample. As the model is linear, table and weights
fold into one number per bucket and language, which is all that scoring needs.

Rejection is calibrated on a part of the sample that is not trained on: a temperature makes the
probabilities honest, and the threshold is the quantile that ``refuse`` of the rightly recognised
calibration texts fall below, at most one half. A text is accepted when it has a letter and its
probability reaches the threshold.

Defined cases: null text, empty text and text without a letter give ``und``, score 0 and are
rejected. A null id is scored like any other and counts as not held out. Repeated rows are scored
alike. With no labelled row every text gives ``und``. Other columns of the input are ignored by
``predict`` and kept by ``accepted``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paneleffect.llm.common import needed, remainder

UNKNOWN = "und"
_TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LETTER = re.compile(r"[^\W\d_]")
_MULTIPLIER = np.uint32(2654435761)


@dataclass(frozen=True)
class Settings:
    """``slots`` bounds the sample: at most so many rows per language, ``crop`` characters of each."""

    slots: int = 512
    crop: int = 4000
    bits: int = 16
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    refuse: float = 0.001
    languages: int = 400
    seed: int = 7


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # language x bucket, temperature included
    bias: np.ndarray
    threshold: float
    bits: int


def _buffer(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cleaned bytes of all texts, a space on either side of each, and where each begins."""
    parts = [b" " + t.encode().translate(_TABLE) + b" " for t in texts]
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    return np.frombuffer(b"".join(parts) + b"   ", dtype=np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def _subwords(data: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length, the bucket of the subword at each position, and whether there is one."""
    n = len(data) - 3
    wide = data.astype(np.uint32)
    space = data == 32
    key = wide[:n] | (wide[1 : n + 1] << np.uint32(8))
    shift = np.uint32(32 - bits)
    inner = space[1 : n + 1]
    yield ((key + np.uint32(2)) * _MULTIPLIER) >> shift, ~(space[:n] & inner)
    key = key | (wide[2 : n + 2] << np.uint32(16))
    yield ((key ^ (key >> np.uint32(13))) * _MULTIPLIER + np.uint32(0x3C6EF372)) >> shift, ~inner
    key = key | (wide[3 : n + 3] << np.uint32(24))
    yield ((key ^ (key >> np.uint32(15))) * _MULTIPLIER + np.uint32(0x78DDE6E4)) >> shift, ~(inner | space[2 : n + 2])


def _features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    data, _ = _buffer([text])
    found = [bucket[real] for bucket, real in _subwords(data, bits)]
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids, (counts / max(1, counts.sum())).astype(np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, str]], settings: Settings = Settings()) -> Model:
    """Fit on (language, text) rows; every fifth row calibrates. Short cuts of the texts are added so
    that short texts are known as well."""
    rows = [(lang, text.lower()) for lang, text in rows if _LETTER.search(text)]
    languages = tuple(sorted({lang for lang, _ in rows}))
    if not languages:
        return Model((), np.zeros((0, 1 << settings.bits), np.float32), np.zeros(0, np.float32), 1.0, settings.bits)
    rng = np.random.default_rng(settings.seed)
    at = {lang: k for k, lang in enumerate(languages)}

    def cuts(text: str) -> list[str]:
        words = text.split()
        out = [text]
        for size in (4, 16):
            start = int(rng.integers(0, max(1, len(words) - size + 1)))
            out.append(" ".join(words[start : start + size]))
        return [t for t in out if _LETTER.search(t)]

    calibration = [r for k, r in enumerate(rows) if k % 5 == 4]
    examples = [(at[lang], *_features(t, settings.bits)) for k, (lang, text) in enumerate(rows) if k % 5 != 4 or len(rows) < 50 for t in cuts(text)]
    table = rng.normal(0, 0.1, (1 << settings.bits, settings.dim)).astype(np.float32)
    weights = rng.normal(0, 0.1, (settings.dim, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    steps, done = settings.epochs * len(examples), 0
    for _ in range(settings.epochs):
        for k in rng.permutation(len(examples)):
            y, ids, share = examples[k]
            rate = np.float32(settings.rate * (1 - done / steps) + 1e-3)
            hidden = share @ table[ids]
            error = _softmax(hidden @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * np.float32(0.1) * error
            table[ids] -= (rate * share * np.float32(50))[:, None] * back
            done += 1
    folded = (table @ weights).T.astype(np.float32)
    known = [(at[lang], *_features(t, settings.bits)) for lang, text in calibration or rows for t in cuts(text)]
    logits = np.array([folded[:, ids] @ share + bias for _, ids, share in known])
    truth = np.array([y for y, _, _ in known])
    heats = np.geomspace(0.25, 16, 49)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in heats]
    heat = heats[int(np.argmin(loss))]
    p = _softmax(logits / heat)
    right = p.argmax(axis=1) == truth
    threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], settings.refuse))) if right.any() else 0.5
    return Model(languages, np.ascontiguousarray(folded / np.float32(heat)), (bias / heat).astype(np.float32), threshold, settings.bits)


def probabilities(texts: list[str], model: Model) -> np.ndarray:
    """Text x language, over the whole texts; equal for texts without a subword."""
    data, starts = _buffer(texts)
    total = np.zeros((len(model.languages), len(texts)))
    count = np.zeros(len(texts))
    for bucket, real in _subwords(data, model.bits):
        for k in range(len(model.languages)):
            total[k] += np.add.reduceat(np.where(real, model.weights[k].take(bucket), np.float32(0)), starts[:-1], dtype=np.float64)
        count += np.add.reduceat(real, starts[:-1], dtype=np.int64)
    return _softmax((total / np.maximum(count, 1)).T + model.bias)


def fit(docs: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Train on at most ``slots`` rows of each language among rows of ``docs`` for which ``learn`` is
    true and text and language are not null.

    The sample takes the row with the smallest id hash of each slot, an aggregate that tasks
    combine before the shuffle, so no language is gathered however common it is.
    """
    spread = F.xxhash64("doc_id")
    rows = docs.where(learn & F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("lang", spread.alias("_h"), F.pmod(spread, F.lit(settings.slots)).alias("_slot"))
    chosen = rows.groupBy("lang", "_slot").agg(F.min("_h").alias("_h")).select("lang", "_h")
    found = chosen.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(settings.languages + 1).count()
    if found > settings.languages:
        raise ValueError(f"More than {settings.languages} languages are labelled; raise Settings.languages.")
    # At most slots x languages pairs of a language and a number: the size of this broadcast is bounded.
    picked = docs.where(learn & F.col("text").isNotNull()).select(
        "lang", spread.alias("_h"), F.substring("text", 1, settings.crop).alias("text")
    )
    got = picked.join(F.broadcast(chosen), ["lang", "_h"]).dropDuplicates(["lang", "_h"]).select("lang", "text", "_h").collect()
    return train([(r["lang"], r["text"]) for r in sorted(got, key=lambda r: (r["lang"], r["_h"]))], settings)


def _score(texts: pa.Array, model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    texts = pc.utf8_lower(texts.cast(pa.large_string()).fill_null(""))
    values = texts.to_pylist()
    letters = np.fromiter((_LETTER.search(t) is not None for t in values), dtype=bool, count=len(values))
    if not model.languages or not values:
        return [UNKNOWN] * len(values), np.zeros(len(values)), np.zeros(len(values), bool)
    p = np.empty((len(values), len(model.languages)))
    first = size = 0
    for k, t in enumerate(values):
        size += len(t)
        if size >= 1 << 19 or k == len(values) - 1:
            p[first : k + 1] = probabilities(values[first : k + 1], model)
            first, size = k + 1, 0
    best = p.argmax(axis=1)
    score = np.where(letters, p.max(axis=1), 0.0)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)], score, letters & (score >= model.threshold)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every row of ``docs``, in one pass without a shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, accepted = _score(batch.column(1), model)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)],
                names=["doc_id", "lang_pred", "score", "accepted"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    return needed(docs, "doc_id", "text").mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double, accepted boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, all columns kept."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _score(batch.column(batch.schema.get_field_index("text")), model)[2]
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(kept, docs.schema)


def learnable(modulus: int = 4, held_out: int = 2) -> Column:
    return remainder("doc_id", modulus) != held_out


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Fit outside the held-out fold, predict everywhere."""
    rows = needed(docs, "doc_id", "text", "lang")
    model = fit(rows, learnable(), settings)
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return predict(rows, model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")
