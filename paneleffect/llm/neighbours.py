"""Embedding near-duplicates by navigable small-world graphs, one hierarchy per shard.

Vectors of one label (and length) are compared by cosine in double precision; pairs of at least
``threshold`` link. Equal vectors count as one with a weight. Each label's vectors are dealt to
shards of bounded size by a hash of their id.

In a shard, vectors are inserted into a hierarchical navigable small-world graph, in random order. A
vector that the search finds within ``cell`` of a node joins that node's cell instead of becoming a
node, so thousands of near copies are one node. Each node, besides its nearest and mutually diverse
neighbours, is kept as a child of the node nearest to it when it came, so all can be reached. A
search for links asks for all nodes within the threshold's angle plus two cells': its beam doubles
while everything it holds is within that. All vectors of two cells that meet are then compared
exactly, in blocks.

Recall audits: nodes, and vectors turned away from them by about the threshold's angle, are searched
in the graph and by comparing with all nodes of the shard. While the graph finds less than
``recall`` of what is there, the beam doubles; a beam as wide as the shard compares with all nodes.

Every shard's nodes are searched in the shard itself and in every other shard of the label. Tasks
return counts and, per vector, the smallest id of its part there, never pairs; parts are united by
connected components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite numbers, and rows with a
null label, have no links and are their own component. A null vec_id stays, with null component and
kept. Rows that repeat a vec_id and vector count as links of each other, like any equal vectors.
Other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneleffect.llm import common
from paneleffect.llm.components import components


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.98
    cell: float = 0.985
    shard_bytes: int = 16 << 20
    neighbours: int = 12
    build_beam: int = 32
    beam: int = 16
    recall: float = 0.99
    audit_rows: int = 128
    block: int = 2048
    seed: int = 11

    @property
    def reach(self) -> float:
        """Nodes whose cells may hold linked vectors are within this cosine."""
        return float(np.cos(min(np.pi, np.arccos(self.threshold) + 2 * np.arccos(self.cell) + 1e-6)))


class Graph:
    """A hierarchy of small-world graphs over unit vectors (float32, for the search only)."""

    def __init__(self, dim: int, s: Settings):
        self.s, self.x = s, np.zeros((64, dim), np.float32)
        self.n = 0
        self.layers: list[dict[int, list[int]]] = []  # from the bottom; lists of neighbours
        self.children: list[list[int]] = []
        self.entry = 0
        self.rng = np.random.default_rng(s.seed)

    def _near(self, q: np.ndarray, entries: list[int], beam: int, layer: dict[int, list[int]], bottom: bool) -> list[tuple[float, int]]:
        """The ``beam`` most similar nodes found, best first."""
        seen = set(entries)
        sims = (self.x[entries] @ q).tolist()
        best = list(zip(sims, entries))
        heapq.heapify(best)
        todo = [(-v, k) for v, k in best]
        heapq.heapify(todo)
        while todo:
            v, k = heapq.heappop(todo)
            if len(best) >= beam and -v < best[0][0]:
                break
            around = layer[k] + self.children[k] if bottom else layer[k]
            new = [j for j in around if not (j in seen or seen.add(j))]  # a child may be a neighbour too
            if not new:
                continue
            for value, j in zip((self.x[new] @ q).tolist(), new):
                if len(best) < beam:
                    heapq.heappush(best, (value, j))
                elif value > best[0][0]:
                    heapq.heapreplace(best, (value, j))
                else:
                    continue
                heapq.heappush(todo, (-value, j))
        return sorted(best, reverse=True)

    def _diverse(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """The best nodes that are nearer to the new one than to those chosen before."""
        ids = [k for _, k in found]
        among = self.x[ids] @ self.x[ids].T
        chosen: list[int] = []
        for i, (value, _) in enumerate(found):
            if len(chosen) == most:
                break
            if not chosen or value > among[i, chosen].max():
                chosen.append(i)
        return [ids[i] for i in chosen]

    def insert(self, q: np.ndarray) -> tuple[int, bool]:
        """(node, whether it is new): an existing node if ``q`` is in its cell."""
        if not self.n:
            return self._add(q, [], 0), True
        level = int(-np.log(1 - self.rng.random()) / np.log(self.s.neighbours))
        at, per_level = [self.entry], []
        for h in range(len(self.layers) - 1, -1, -1):
            if h > level:
                at = [self._near(q, at, 1, self.layers[h], h == 0)[0][1]]
            else:
                found = self._near(q, at, self.s.build_beam, self.layers[h], h == 0)
                at = [k for _, k in found]
                per_level.append((h, found))
        best_value, best = per_level[-1][1][0]
        if best_value >= self.s.cell:
            return best, False
        node = self._add(q, per_level, level)
        self.children[best].append(node)
        return node, True

    def _add(self, q: np.ndarray, per_level: list, level: int) -> int:
        node = self.n
        if node == len(self.x):
            self.x = np.concatenate([self.x, np.zeros_like(self.x)])
        self.x[node] = q
        self.n += 1
        self.children.append([])
        for h, found in per_level:
            layer, room = self.layers[h], self.s.neighbours * (2 if h == 0 else 1)
            layer[node] = self._diverse(found, self.s.neighbours)
            for other in layer[node]:
                back = layer[other]
                if len(back) < room:
                    back.append(node)
                else:
                    sims = self.x[back] @ self.x[other]
                    worst = int(sims.argmin())
                    if sims[worst] < float(self.x[other] @ q):
                        back[worst] = node
        for _ in range(len(self.layers), level + 1):
            self.layers.append({node: []})
            self.entry = node
        return node

    def within(self, q: np.ndarray, reach: float, beam: int) -> list[int]:
        """The nodes found within a cosine of q: the beam widens while all it holds are."""
        while True:
            if beam >= self.n:
                return np.flatnonzero(self.x[: self.n] @ q >= reach).tolist()
            at = [self.entry]
            for layer in self.layers[:0:-1]:
                at = [self._near(q, at, 1, layer, False)[0][1]]
            found = self._near(q, at, beam, self.layers[0], True)
            if found[-1][0] < reach:
                return [k for value, k in found if value >= reach]
            beam *= 2

    def audited(self) -> tuple[int, float]:
        """The beam that passes the audit, and the recall there."""
        beam, rng = self.s.beam, np.random.default_rng(self.s.seed + 1)
        rows = rng.choice(self.n, size=min(self.n, self.s.audit_rows), replace=False)
        away = rng.normal(size=(len(rows), self.x.shape[1])).astype(np.float32)
        away -= (away * self.x[rows]).sum(axis=1, keepdims=True) * self.x[rows]
        away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)
        t = np.float32(self.s.threshold)
        queries = np.concatenate([self.x[rows], t * self.x[rows] + np.sqrt(1 - t * t) * away])
        truth = queries @ self.x[: self.n].T >= self.s.reach
        while True:
            found = sum(int(truth[k, self.within(q, self.s.reach, beam)].sum()) for k, q in enumerate(queries))
            recall = found / max(1, int(truth.sum()))
            if recall >= self.s.recall or beam >= self.n:
                return beam, recall
            beam *= 2


class Shard:
    """A shard's vectors, their cells and the graph over the cells' nodes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, weights: np.ndarray, s: Settings):
        order = np.random.default_rng(s.seed).permutation(len(ids))
        self.ids, self.weights, self.s = ids[order], weights[order], s
        # Scaled first: the squares of very large or very small numbers leave the range.
        scaled = vectors[order] / np.abs(vectors[order]).max(axis=1, keepdims=True)
        self.unit = scaled / np.linalg.norm(scaled, axis=1, keepdims=True)
        self.graph = Graph(vectors.shape[1], s)
        cells: list[list[int]] = []
        for k, q in enumerate(self.unit.astype(np.float32)):
            node, new = self.graph.insert(q)
            cells.append([k]) if new else cells[node].append(k)
        self.cells = [np.array(c) for c in cells]
        self.beam, self.recall = self.graph.audited()


def _meetings(a: Shard, b: Shard) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Members of a and of b, as positions, for each pair of cells that may hold links."""
    for node in range(b.graph.n):
        for other in a.graph.within(b.graph.x[node], a.s.reach, a.beam):
            if a is not b or other <= node:
                yield a.cells[other], b.cells[node]


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, k: int) -> int:
        while self.up[k] != k:
            self.up[k] = self.up[self.up[k]]
            k = self.up[k]
        return k

    def join(self, j: int, k: int) -> None:
        self.up[self.find(j)] = self.find(k)


def _join(near: np.ndarray, x: np.ndarray, y: np.ndarray, union: _Union) -> None:
    """Unite the rows and columns that the true cells of a matrix connect."""
    left = near.any(axis=1)
    while left.any():
        rows = np.zeros(len(x), dtype=bool)
        rows[left.argmax()] = True
        while True:
            columns = near[rows].any(axis=0)
            more = near[:, columns].any(axis=1)
            if (more == rows).all():
                break
            rows = more
        root = int(x[rows.argmax()])
        for k in (*x[rows].tolist(), *y[columns].tolist()):
            union.join(k, root)
        left &= ~rows


def linked(a: Shard, b: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, part) of the vectors with links between a and b, which may be the same shard."""
    shift = 0 if a is b else len(a.ids)
    ids = a.ids if a is b else np.concatenate([a.ids, b.ids])
    count, union, block = np.zeros(len(ids), np.int64), _Union(len(ids)), a.s.block
    for left, right in _meetings(a, b):
        same = left is right
        if same and len(left) == 1:
            continue
        for i in range(0, len(left), block):
            for j in range(i if same else 0, len(right), block):
                x, y = left[i : i + block], right[j : j + block]
                near = a.unit[x] @ b.unit[y].T >= a.s.threshold
                if not near.any():
                    continue
                mirror = same and i == j
                if mirror:
                    np.fill_diagonal(near, False)
                count[x] += near @ b.weights[y]
                if not mirror:
                    count[y + shift] += a.weights[x] @ near
                _join(near, x, y + shift, union)
    return _parts(ids, count, union)


def _parts(ids: np.ndarray, count: np.ndarray, union: _Union) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    has = np.flatnonzero(count)
    least: dict[int, int] = {}
    roots = [union.find(int(k)) for k in has]
    for k, root in zip(has.tolist(), roots):
        least[root] = min(least.get(root, int(ids[k])), int(ids[k]))
    return ids[has], count[has], np.array([least[r] for r in roots], dtype=np.int64)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label, dim and v (doubles) of the vectors that can link."""
    v = F.col("embedding").cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.size(v).alias("dim"), v.alias("v"))


_PART = "kind string, id long, n long, part long, label string, dim int, shard int, recall double, beam int, graph binary"
_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _records(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> dict:
    ids, count, part = rows
    return {"kind": ["links"] * len(ids), "id": ids, "n": count, "part": part}


_PART_SCHEMA = pa.schema([("kind", pa.string()), ("id", pa.int64()), ("n", pa.int64()), ("part", pa.int64()), ("label", pa.string()), ("dim", pa.int32()), ("shard", pa.int32()), ("recall", pa.float64()), ("beam", pa.int32()), ("graph", pa.binary())])


def index(rows: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(equal vectors with their representative and weight, the shards' numbers, their graphs and links)."""
    good = usable(rows).withColumn("label", F.col("label").cast("string"))
    same = good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    sizes = good.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("rows"))
    room = F.greatest(F.lit(1), F.floor(F.lit(s.shard_bytes) / (F.col("dim") * 8)))
    sizes = common.stage(sizes.select("label", "dim", F.ceil(F.col("rows") / room).cast("int").alias("shards")), "shards")
    dealt = same.join(sizes, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("label", "dim", "shard", "shards")}
        table = table.sort_by("rep")
        ids, weights = (table.column(c).combine_chunks().to_numpy() for c in ("rep", "weight"))
        flat = table.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), first["dim"])
        shard = Shard(ids, flat, weights, s)
        out = _records(linked(shard, shard))
        blob = _packed(shard) if first["shards"] > 1 else None
        n = len(out["id"])
        rest = {"label": first["label"], "dim": first["dim"], "shard": first["shard"], "recall": shard.recall, "beam": shard.beam, "graph": blob}
        columns = {c: [*v, "graph" if c == "kind" else None] for c, v in out.items()} | {c: [None] * n + [v] for c, v in rest.items()}
        return pa.Table.from_batches([common.records(_PART_SCHEMA, **columns)])

    built = dealt.select("label", "dim", "shard", "shards", "rep", "weight", "v").groupBy("label", "dim", "shard").applyInArrow(build, _PART)
    return good, sizes, common.stage(built, "graphs")


def _packed(shard: Shard) -> bytes:
    g = shard.graph
    return pickle.dumps((shard.ids, shard.weights, shard.unit, shard.cells, shard.beam, g.x[: g.n], g.layers, g.children, g.entry))


def _opened(blob: bytes, s: Settings) -> Shard:
    shard, g = Shard.__new__(Shard), Graph.__new__(Graph)
    shard.ids, shard.weights, shard.unit, shard.cells, shard.beam, g.x, g.layers, g.children, g.entry = pickle.loads(blob)
    shard.graph, shard.s, g.s, g.n = g, s, s, len(g.x)
    return shard


def _across(built: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """Links between different shards of a label: each pair of shards is one row of work."""
    first = F.explode(F.sequence(F.lit(0), F.col("shards") - 2)).alias("i")
    pairs = sizes.where("shards > 1").select("label", "dim", "shards", first)
    pairs = pairs.select("label", "dim", "i", F.explode(F.sequence(F.col("i") + 1, F.col("shards") - 1)).alias("j"))
    graphs = built.where("kind = 'graph'").select("label", "dim", "shard", "graph")
    work = pairs.join(graphs.withColumnsRenamed({"shard": "i", "graph": "a"}), ["label", "dim", "i"])
    work = work.join(graphs.withColumnsRenamed({"shard": "j", "graph": "b"}), ["label", "dim", "j"]).select("a", "b")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                out = _records(linked(_opened(a.as_py(), s), _opened(b.as_py(), s)))
                yield pa.RecordBatch.from_arrays([pa.array(out[c], pa.int64()) for c in ("id", "n", "part")], names=["id", "n", "part"])

    return work.mapInArrow(search, "id long, n long, part long")


def classes(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = common.needed(rows, "vec_id", "embedding", "label")
    good, sizes, built = index(rows, s)
    parts = built.where("kind = 'links'").select("id", "n", "part").unionByName(_across(built, sizes, s))
    parts = common.stage(parts, "vector-links")
    v = F.xxhash64("v")
    least = good.groupBy("label", "dim", "v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"))
    mapped = good.withColumn("_h", v).join(least.withColumn("_h", v), ["label", "dim", "_h", "v"]).select("vec_id", "rep", "weight")
    mapped = common.stage(mapped, "vector-representatives")
    # Rows of one id with different vectors are one place: their representatives belong together.
    several = mapped.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("_most")).where("a <> _most").select("vec_id", "a")
    same_id = mapped.join(several, "vec_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    joined = components(parts.select(F.col("id").alias("a"), F.col("part").alias("b")).unionByName(same_id))
    found = parts.groupBy("id").agg(F.sum("n").alias("found"))
    known = (
        mapped.join(found.withColumnRenamed("id", "rep"), "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("vec_id", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        .groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    )
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def audits(rows: DataFrame, s: Settings = Settings()) -> DataFrame:
    """label, dim, shard, recall and beam of every shard's audit."""
    return index(common.needed(rows, "vec_id", "embedding", "label"), s)[2].where("kind = 'graph'").select("label", "dim", "shard", "recall", "beam")
