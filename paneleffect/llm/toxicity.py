"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and its ASCII non-letters become spaces. Each word enters as the embedding of
itself beside the mean embedding of its four-byte pieces, edges included. Words and pieces that
fewer than ``support`` texts of the sample have share one embedding, the unknown one. Words are read in
overlapping windows; in each, a gated recurrent layer runs in both directions, attention weighs
its states, and the pooled state gives a logit. A text's logit is the largest of all its windows,
mapped to a probability on rows that were not trained on (Platt scaling), each class weighted by its
labelled rows per sampled row, so that a probability is that of the labelled rows whatever the sample's
class ratio.

Training is multiple-instance: labels are of texts, so each round scores all windows of the sample and
trains on the strongest window of each text (and, of clean texts, on a random one), by back
propagation through time and Adam. Gates use ``x / (1 + |x|)`` in place of exponentials.

Ids are dealt by hash: four in five may be trained on, one in five may calibrate. Of each part ``slots``
rows per class are sampled. Trained texts have at most ``longest`` characters; calibration takes texts
of every length, whose windows are scored where the rows are, and only the logits are gathered.
Scoring covers every window of every text, in one pass without a shuffle.

Defined cases: null texts, and texts without a word, score 0. A null id is scored and counts as not held
out. Labels other than 0 and 1 are not learned from; an id labelled more than once is toxic if any
label says so. Where the part that may be trained on lacks a class, all sampled rows are; where the part
that calibrates lacks one, all calibrate. Without labels of both classes every text scores the toxic
share of the labels, 0 without any. Repeated rows score alike. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneleffect.llm import common


@dataclass(frozen=True)
class Settings:
    window: int = 32
    stride: int = 24
    hidden: int = 8
    dim: int = 8
    attention: int = 8
    support: int = 4
    slots: int = 800
    longest: int = 20_000
    rounds: int = 10
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.7
    seed: int = 5


_CLEAN = np.frombuffer(bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)), dtype=np.uint8)
Weights = dict[str, np.ndarray]


@dataclass(frozen=True)
class Model:
    weights: Weights
    known: Known | None
    scale: float
    shift: float
    constant: float | None
    settings: Settings


@dataclass(frozen=True)
class Known:
    """Sorted hashes of the words, and the pieces, that have an embedding of their own."""

    words: np.ndarray
    pieces: np.ndarray


def _looked_up(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place in ``known`` plus one; 0 for others."""
    if not len(known):
        return np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at + 1, 0)


class _Words:
    """The distinct words of a slice of texts, and its windows."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, s: Settings, known: Known | None = None):
        data = _CLEAN[data]
        starts, ends, before = common.word_spans(data, offsets)
        hashes = common.word_hashes(data, starts, ends, lower=False)
        _, first, self.row = np.unique(hashes, return_index=True, return_inverse=True)
        self.hash = hashes[first]
        # The pieces of a word: every four bytes from the space before it to the space behind it.
        begin, length = starts[first], (ends - starts)[first]
        self.size = np.maximum(1, length - 1)
        self.piece_begin = np.cumsum(self.size) - self.size
        inside = np.arange(self.size.sum()) - np.repeat(self.piece_begin, self.size)
        begin, length = np.repeat(begin, self.size), np.repeat(length, self.size)
        key = np.zeros(len(inside), dtype=np.uint32)
        for k in range(4):
            at = inside + (k - 1)
            outside = (at < 0) | (at >= length)
            byte = np.where(outside, 32, data[np.where(outside, begin, begin + at)]) if len(data) else key
            key |= byte.astype(np.uint32) << np.uint32(8 * k)
        self.piece_key = key
        if known is not None:
            self.learn(known)
        n = np.diff(before)
        many = np.where(n > 0, 1 + np.maximum(0, -(-(n - s.window) // s.stride)), 0)
        self.many = many
        self.text = np.repeat(np.arange(len(n)), many)
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.start = before[:-1][self.text] + rank * s.stride
        self.end = np.minimum(self.start + s.window, before[1:][self.text])

    def learn(self, known: Known) -> None:
        self.bucket, self.piece = _looked_up(self.hash, known.words), _looked_up(self.piece_key, known.pieces)

    def rows(self, windows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(step x window: the word's row, 0 where there is none; 1 or 0)."""
        at = self.start[windows] + np.arange(window)[:, None]
        real = at < self.end[windows]
        return np.where(real, self.row[np.minimum(at, len(self.row) - 1)], 0), real.astype(np.float32)[..., None]


def _initial(s: Settings, known: Known) -> Weights:
    rng = np.random.default_rng(s.seed)
    h, draw = s.hidden, lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    return {
        "word": rng.normal(0, 0.1, (len(known.words) + 1, s.dim)).astype(np.float32), "piece": rng.normal(0, 0.1, (len(known.pieces) + 1, s.dim)).astype(np.float32),
        "input": draw(2 * s.dim, 6 * h), "bias": np.zeros(6 * h, np.float32), "forth": draw(h, 3 * h), "back": draw(h, 3 * h),
        "look": draw(2 * h, s.attention), "ask": draw(s.attention, 1), "out": draw(2 * h, 1), "last": np.zeros(1, np.float32),
    }


def _soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x / (1 + |x|) and its derivative."""
    d = np.float32(1) / (np.float32(1) + np.abs(x))
    return x * d, d * d


def _gate(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y, d = _soft(x)
    return np.float32(0.5) * y + np.float32(0.5), np.float32(0.5) * d


def _layer(gx: np.ndarray, table: np.ndarray | None, rows: np.ndarray | None, real: np.ndarray, u: np.ndarray, reverse: bool, keep: bool):
    """States of one direction. Inputs are ``gx`` per step, or rows of ``table``."""
    steps, h = len(real), u.shape[0]
    state = np.zeros((real.shape[1], h), np.float32)
    states = np.empty((steps, real.shape[1], h), np.float32)
    memory = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        g = gx[t] if table is None else table[rows[t]]
        both, d_both = _gate(g[:, : 2 * h] + state @ u[:, : 2 * h])
        z, r = both[:, :h], both[:, h:]
        c, d_c = _soft(g[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
        if keep:
            memory.append((t, state, z, r, c, d_both, d_c))
        state = state + real[t] * z * (c - state)
        states[t] = state
    return states, memory


def _layer_back(d_states: np.ndarray, memory: list, real: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = u.shape[0]
    d_g = np.empty((*d_states.shape[:2], 3 * h), np.float32)
    d_u = np.zeros_like(u)
    d_next = np.zeros(d_states.shape[1:], np.float32)
    for t, before, z, r, c, d_both, d_c in reversed(memory):
        d = d_next + d_states[t]
        m = real[t]
        d_z = d * m * (c - before) * d_both[:, :h]
        d_cand = d * m * z * d_c
        d_rh = d_cand @ u[:, 2 * h :].T
        d_r = d_rh * before * d_both[:, h:]
        gates = np.concatenate([d_z, d_r], axis=1)
        d_next = d * (1 - m * z) + d_rh * r + gates @ u[:, : 2 * h].T
        d_u[:, : 2 * h] += before.T @ gates
        d_u[:, 2 * h :] += (r * before).T @ d_cand
        d_g[t, :, : 2 * h], d_g[t, :, 2 * h :] = gates, d_cand
    return d_g, d_u


def _pooled(states: np.ndarray, real: np.ndarray, w: Weights):
    looked, d_looked = _soft(states @ w["look"])
    asked = (looked @ w["ask"])[..., 0] + np.where(real[..., 0] > 0, np.float32(0), np.float32(-1e9))
    share = np.exp(asked - asked.max(axis=0))
    share /= share.sum(axis=0)
    return np.einsum("tb,tbh->bh", share, states), share, looked, d_looked


def _inputs(words: _Words, w: Weights) -> np.ndarray:
    """Gate inputs of each distinct word, both directions: the input layer folds into the embeddings."""
    dim = w["word"].shape[1]
    by_word = w["word"][words.bucket] @ w["input"][:dim] + w["bias"]
    if not len(words.piece):
        return by_word
    pieces = np.add.reduceat(w["piece"][words.piece], words.piece_begin, axis=0) / words.size[:, None].astype(np.float32)
    return by_word + pieces @ w["input"][dim:]


def window_logits(words: _Words, w: Weights, s: Settings, most: int = 8192) -> np.ndarray:
    table, h = _inputs(words, w), s.hidden
    forth, back = np.ascontiguousarray(table[:, : 3 * h]), np.ascontiguousarray(table[:, 3 * h :])
    out = np.empty(len(words.start), np.float32)
    for first in range(0, len(out), most):
        own = np.arange(first, min(first + most, len(out)))
        rows, real = words.rows(own, s.window)
        a, _ = _layer(None, forth, rows, real, w["forth"], False, False)
        b, _ = _layer(None, back, rows, real, w["back"], True, False)
        pooled = _pooled(np.concatenate([a, b], axis=2), real, w)[0]
        out[own] = (pooled @ w["out"])[:, 0] + w["last"][0]
    return out


def _gradients(words: _Words, windows: np.ndarray, y: np.ndarray, weight: np.ndarray, w: Weights, s: Settings) -> Weights:
    h, dim = s.hidden, s.dim
    rows, real = words.rows(windows, s.window)
    used, local = np.unique(rows, return_inverse=True)
    local = local.reshape(rows.shape)
    size = words.size[used]
    pieces = np.concatenate([words.piece[b : b + n] for b, n in zip(words.piece_begin[used], size)])
    begin = np.cumsum(size) - size
    x = np.concatenate([w["word"][words.bucket[used]], np.add.reduceat(w["piece"][pieces], begin, axis=0) / size[:, None].astype(np.float32)], axis=1)
    g = (x @ w["input"] + w["bias"])[local]
    a, m_a = _layer(g[..., : 3 * h], None, None, real, w["forth"], False, True)
    b, m_b = _layer(g[..., 3 * h :], None, None, real, w["back"], True, True)
    states = np.concatenate([a, b], axis=2)
    pooled, share, looked, d_looked = _pooled(states, real, w)
    logit = (pooled @ w["out"])[:, 0] + w["last"][0]
    d_logit = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) * weight / len(y)).astype(np.float32)
    out: Weights = {"out": pooled.T @ d_logit[:, None], "last": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * w["out"][:, 0]
    d_share = np.einsum("bh,tbh->tb", d_pooled, states)
    d_asked = share * (d_share - (share * d_share).sum(axis=0))
    out["ask"] = np.einsum("tba,tb->a", looked, d_asked)[:, None]
    d_look = d_asked[..., None] * w["ask"][:, 0] * d_looked
    out["look"] = np.einsum("tbh,tba->ha", states, d_look)
    d_states = share[..., None] * d_pooled + d_look @ w["look"].T
    d_a, out["forth"] = _layer_back(np.ascontiguousarray(d_states[..., :h]), m_a, real, w["forth"])
    d_b, out["back"] = _layer_back(np.ascontiguousarray(d_states[..., h:]), m_b, real, w["back"])
    flat = np.concatenate([d_a, d_b], axis=2) * real
    d_g = np.zeros((len(used), 6 * h), np.float32)
    np.add.at(d_g, local.ravel(), flat.reshape(-1, 6 * h))
    out["input"], out["bias"] = x.T @ d_g, d_g.sum(axis=0)
    d_x = d_g @ w["input"].T
    out["word"], out["piece"] = np.zeros_like(w["word"]), np.zeros_like(w["piece"])
    np.add.at(out["word"], words.bucket[used], d_x[:, :dim])
    np.add.at(out["piece"], pieces, np.repeat(d_x[:, dim:] / size[:, None], size, axis=0))
    return out


class _Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items()}
        self.v = {k: np.zeros_like(v) for k, v in w.items()}

    def step(self, grads: Weights) -> None:
        self.t += 1
        fix = np.float32(np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t) * self.rate)
        for k, g in grads.items():
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.v[k] += np.float32(0.001) * (g * g - self.v[k])
            self.w[k] -= fix * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-7))


def _read(texts: list[str], s: Settings) -> _Words:
    raw = [t.lower().encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return _Words(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, s)


def _strongest(words: _Words, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts that have a window, the window with the largest logit of each)."""
    texts = np.flatnonzero(words.many)
    first = (np.cumsum(words.many) - words.many)[texts]
    best = np.maximum.reduceat(logits, first) if len(texts) else np.zeros(0, np.float32)
    order = np.lexsort((-logits, words.text))
    return texts, order[first] if len(best) else np.zeros(0, np.int64)


def train(rows: list[tuple[int, str]], s: Settings = Settings()) -> Model:
    """Fit on (label, text) rows in a fixed order, all of them; the logits are not calibrated yet."""
    labels = np.array([y for y, _ in rows], dtype=np.float32)
    if len(set(labels.tolist())) < 2:
        return Model({}, None, 1.0, 0.0, float(labels.mean()) if len(labels) else 0.0, s)
    words = _read([t for _, t in rows], s)
    texts = np.flatnonzero(words.many)
    if len(set(labels[texts].tolist())) < 2:
        return Model({}, None, 1.0, 0.0, float(labels.mean()), s)
    rng = np.random.default_rng(s.seed + 1)
    begin = np.cumsum(words.many) - words.many
    toxic = int(labels[texts].sum())
    balance = np.where(labels > 0, (len(texts) - toxic) / toxic, 1.0).astype(np.float32)
    known, odds = _support(words, labels, texts, s)
    words.learn(known)
    w = _initial(s, known)
    for name in odds:
        w[name][1:, 0] = odds[name]
    adam = _Adam(w, s.rate)
    for turn in range(s.rounds):
        logits = window_logits(words, w, s)
        _, best = _strongest(words, logits)
        strongest = dict(zip(texts.tolist(), best.tolist()))
        chosen = [(strongest[k], k) for k in texts.tolist()]
        chosen += [(int(begin[k] + rng.integers(words.many[k])), k) for k in texts.tolist() if not labels[k]]
        chosen = np.array(chosen)[rng.permutation(len(chosen))]
        adam.rate = s.rate * (1 - turn / (s.rounds + 1))
        for first in range(0, len(chosen), s.batch):
            part = chosen[first : first + s.batch]
            adam.step(_gradients(words, part[:, 0], labels[part[:, 1]], balance[part[:, 1]], w, s))
    return Model(w, known, 1.0, 0.0, None, s)


def _support(words: _Words, labels: np.ndarray, learned: np.ndarray, s: Settings) -> tuple[Known, Weights]:
    """The words and pieces of enough texts, and their log odds in toxic texts, with which one number of
    their embeddings starts."""
    pairs = {"word": ([], []), "piece": ([], [])}
    for k in learned.tolist():
        first, last = np.searchsorted(words.text, [k, k + 1])
        rows = np.unique(words.row[words.start[first] : words.end[last - 1]])
        pieces = np.concatenate([words.piece_key[b : b + n] for b, n in zip(words.piece_begin[rows], words.size[rows])])
        for name, own in (("word", words.hash[rows]), ("piece", np.unique(pieces))):
            pairs[name][int(labels[k])].append(own)
    totals = np.bincount(labels[learned].astype(int), minlength=2) + 1
    kept, odds = {}, {}
    for name, (clean, toxic) in pairs.items():
        value, count = np.unique(np.concatenate(clean + toxic), return_counts=True)
        value = value[count >= s.support]
        share = []
        for own, total in zip((clean, toxic), totals):
            at = _looked_up(np.concatenate(own), value) if own else np.zeros(0, np.int64)
            share.append((np.bincount(at, minlength=len(value) + 1)[1:] + 0.5) / total)
        kept[name] = value
        odds[name] = (np.clip(np.log(share[1] / share[0]), -3, 3) * 0.3).astype(np.float32)
    return Known(kept["word"], kept["piece"]), odds


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Scale and shift of the logits by Newton steps, with smoothed targets and weighted rows."""
    weight = weight * (len(y) / weight.sum())
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        slope = design.T @ (weight * (p - target)) + 1e-3 * (theta - [1.0, 0.0])
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        theta = theta - step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return float(theta[0]), float(theta[1])


def _logits(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose second column is the text, the rows of a slice that have a window, and the
    largest logit of each."""
    lower = pc.utf8_lower(batch.column(1).cast(pa.large_string()).fill_null(""))
    for part, data, offsets in common.slices(batch.set_column(1, "text", lower), "text"):
        words = _Words(data, offsets, model.settings, model.known)
        if model.constant is not None:
            yield part, np.flatnonzero(words.many), np.zeros(np.count_nonzero(words.many))
        else:
            logits = window_logits(words, model.weights, model.settings)
            texts, best = _strongest(words, logits)
            yield part, texts, logits[best].astype(float)


def _calibrated(model: Model, docs: DataFrame, sample: DataFrame, counts: dict[int, int]) -> Model | None:
    """``model`` with Platt scaling on the sampled rows, weighted to the ``counts`` of the classes; none
    where the sample lacks a class."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, logits in _logits(batch, model):
                own = part.take(pa.array(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), pa.array(logits)], names=["h", "toxic", "logit"])

    rows = docs.join(F.broadcast(sample.select("doc_id", "toxic", "h")), "doc_id").select("h", "text", "toxic")
    judged = rows.mapInArrow(judge, "h long, toxic int, logit double").groupBy("h", "toxic").agg(F.max("logit").alias("logit"))
    got = sorted((r["h"], r["toxic"], r["logit"]) for r in judged.collect())
    y = np.array([r[1] for r in got], dtype=float)
    if len(set(y.tolist())) < 2:
        return None
    sampled = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    weight = np.array([counts[k] / sampled[k] for k in y.astype(int).tolist()])
    scale, shift = _platt(np.array([r[2] for r in got]), y, weight)
    return replace(model, scale=scale, shift=shift)


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, s: Settings = Settings()) -> Model:
    """Train, and calibrate, on at most ``slots`` labelled rows per class each, outside the held-out fold:
    those with the smallest id hashes of the rows that come first in one of eight times as many cells. The
    aggregate over cells is combined by tasks before the shuffle and counts all labelled rows of the fold."""
    known = common.needed(labels, "doc_id", "toxic").where(F.col("toxic").isin(0, 1) & (common.remainder("doc_id", modulus) != held_out))
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    docs = common.needed(docs, "doc_id", "text").where(F.length("text") > 0)
    spread = F.xxhash64("doc_id")
    calibrates = F.pmod(F.xxhash64("doc_id", F.lit("calibrates")), F.lit(5)) == 4
    rows = docs.select("doc_id", (F.length("text") <= s.longest).alias("short")).join(known, "doc_id")
    rows = rows.select("toxic", "doc_id", "short", calibrates.alias("calibrates"), spread.alias("h"), F.pmod(spread, F.lit(8 * s.slots)).alias("slot"))
    usable = F.when(F.col("short") | F.col("calibrates"), F.col("h"))
    cells = rows.groupBy("toxic", "calibrates", "slot").agg(F.min(usable).alias("h"), F.min_by("doc_id", usable).alias("doc_id"), F.count("*").alias("n"))
    cells = common.stage(cells, "toxicity-sample")
    counts = {r["toxic"]: r["n"] for r in cells.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    # At most four times ``slots`` ids: the size of the broadcasts is bounded. Eight times as many cells
    # leave a rare class nearly whole.
    rank = F.row_number().over(Window.partitionBy("toxic", "calibrates").orderBy("h", "doc_id"))
    chosen = cells.where(F.col("h").isNotNull()).withColumn("rank", rank).where(F.col("rank") <= s.slots)
    model = None
    for part in (chosen.where(~F.col("calibrates")), chosen):
        texts = docs.where(F.length("text") <= s.longest).join(F.broadcast(part.select("doc_id", "toxic", "h")), "doc_id")
        got = texts.dropDuplicates(["doc_id"]).select("toxic", "text", "h").collect()
        model = train([(r["toxic"], r["text"]) for r in sorted(got, key=lambda r: (r["h"], r["toxic"]))], s)
        if model.constant is None or len(counts) < 2:
            break
    if model.constant is not None:
        return replace(model, constant=counts.get(1, 0) / sum(counts.values()) if counts else 0.0)
    return _calibrated(model, docs, chosen.where("calibrates"), counts) or _calibrated(model, docs, chosen, counts) or model


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row."""
    s = model.settings

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts, logits in _logits(batch, model):
                score = np.zeros(len(part))
                if model.constant is not None:
                    score[texts] = model.constant
                else:
                    score[texts] = 1 / (1 + np.exp(-np.clip(model.scale * logits + model.shift, -500, 500)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= s.threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = dict(docs.dtypes)["doc_id"]
    return common.needed(docs, "doc_id", "text").mapInArrow(judge, f"doc_id {kind}, score double, predicted int")


def rate(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Fit outside the held-out fold, score everywhere."""
    held = F.coalesce(common.remainder("doc_id", 3) == 1, F.lit(False))
    return scores(docs, fit(docs, labels, s=s)).select("doc_id", held.alias("held_out"), "score", "predicted")
