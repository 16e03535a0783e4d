"""Embedding neighbours and components against brute force."""

import numpy as np
import pytest

from paneleffect.llm import neighbours
from paneleffect.llm.components import components


def planted(seed=3, clusters=12, dim=24):
    rng = np.random.default_rng(seed)
    rows = []

    def unit(v):
        return v / np.linalg.norm(v)

    for c in range(clusters):
        centre = unit(rng.normal(size=dim))
        for _ in range(int(rng.integers(1, 25))):
            rows.append((c % 3, unit(centre + rng.normal(size=dim) * rng.choice([0.002, 0.02, 0.03])) * rng.choice([1.0, 3.0])))
    rows += [(k % 3, rng.normal(size=dim)) for k in range(200)]
    rows += [rows[0]] * 5
    order = rng.permutation(len(rows))
    return [(int(k), [float(np.float32(x)) for x in rows[i][1]], int(rows[i][0])) for k, i in enumerate(order)]


def brute(rows, threshold=0.98):
    good = [(k, np.array(v, float), lab) for k, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, up = {k: 0 for k, *_ in rows}, {k: k for k, *_ in rows}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return links, {k: find(k) for k in up}


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("settings", [neighbours.Settings(), neighbours.Settings(shard_bytes=24 * 8 * 40, block=3)])
def test_links_match_brute_force(spark, settings):
    rows = planted()
    odd = [(5000, None, 1), (5001, [], 1), (5002, [0.0] * 24, 1), (5003, [None] * 24, 1), (5004, [float("nan")] * 24, 1), (5005, rows[0][1], None), (5006, rows[0][1][:5], rows[0][2])]
    links, component = brute(rows + odd)
    out = {r["vec_id"]: r for r in neighbours.classes(spark.createDataFrame(rows + odd, SCHEMA), settings).collect()}
    assert len(out) == len(rows) + len(odd)
    true, found = sum(links.values()), sum(r["n_links"] for r in out.values())
    assert all(r["n_links"] <= links[k] for k, r in out.items()) and found >= 0.99 * true > 100
    assert np.mean([out[k]["component_id"] == c for k, c in component.items()]) > 0.99
    assert all(r["kept"] == (k == r["component_id"]) for k, r in out.items())


def test_recall_of_the_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in frame.collect()]
    links, component = brute(rows)
    out = {r["vec_id"]: r for r in neighbours.classes(frame).collect()}
    assert sum(r["n_links"] for r in out.values()) >= 0.9 * sum(links.values())
    audit = neighbours.audits(frame).collect()
    assert audit and all(r["recall"] >= 0.99 for r in audit)


def test_rows_that_repeat_an_id_with_other_vectors_are_one_place(spark):
    v, w, x = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v, 0), (5, v, 0), (5, w, 0), (7, w, 0), (9, x, 0), (9, x, 1), (11, x, 1)]
    out = {(r["vec_id"], r["component_id"], r["kept"]) for r in neighbours.classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {(1, 1, True), (5, 1, False), (7, 1, False), (9, 9, True), (11, 9, False)}


def test_no_vectors(spark):
    assert neighbours.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    links = spark.createDataFrame(chain + star + [(500, 500), (7, 3), (200, 201), (202, 201)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {k: 200 for k in (200, 201, 202)}
    assert got == want
    assert components(links.where("false")).count() == 0
