"""Embedding near-dedup against brute force, also with tiny shards and blocks, and on odd rows."""

import numpy as np
import pytest

from prosa.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node string, n string, least string"


def rows_of(seed, n=240, size=16):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        centre = np.random.default_rng(1000 + i % 12).normal(size=size)
        out.append((i, [float(x) for x in np.float32(centre + r.normal(size=size) * r.choice([0.0, 0.1, 0.4]))], i % 3, "x", "x", "x"))
    return out


def by_rule(rows, threshold=0.98):
    good = [x for x in rows if x[2] is not None and x[1] and all(v is not None and np.isfinite(v) for v in x[1]) and any(x[1])]
    links, parent = {x[0]: 0 for x in rows}, {x[0]: x[0] for x in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a[0] != b[0] and a[2] == b[2] and len(a[1]) == len(b[1]):
                u, v = np.array(a[1], float), np.array(b[1], float)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                    links[a[0]] += 1
                    x, y = sorted((root(a[0]), root(b[0])))
                    parent[y] = x
    return {i: (links[i], root(i)) for i in links}


@pytest.mark.parametrize("small", [False, True])
def test_against_rule(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(vectors, "TARGET", 40)
        monkeypatch.setattr(vectors, "MOST", 30)
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA)
    out = vectors.near_duplicates(df)
    got, want = {r["vec_id"]: r for r in out.collect()}, by_rule(rows)
    assert all(got[i]["n_links"] <= want[i][0] for i in want)
    found, true = sum(r["n_links"] for r in got.values()), sum(n for n, _ in want.values())
    assert found >= 0.95 * true
    assert sum(got[i]["component_id"] == want[i][1] for i in want) >= 0.95 * len(want)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert vectors.recall(df, out, every=10) >= 0.9


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, [2.0, 4.0, 6.0], 1), (4, v, 2), (5, v, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 1.0], 1),
            (9, [1.0, float("nan"), 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [], 1), (12, [1.0, 2.0], 1), (None, v, 1), (2, v, 1)]
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    out = [tuple(r) for r in vectors.near_duplicates(df).collect()]
    assert len(out) == len(rows)
    assert sorted(out, key=str) == sorted([
        (1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False), (4, 0, 4, True), (5, 0, 5, True),
        (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True), (10, 0, 10, True), (11, 0, 11, True), (12, 0, 12, True)], key=str)
    assert vectors.near_duplicates(df.limit(0)).count() == 0
    assert vectors.recall(df, vectors.near_duplicates(df), every=1) == 1.0
    assert vectors.audited(df.limit(0)).columns == ["vec_id", "n_links", "component_id", "kept", "recall"]


def test_audit(spark, monkeypatch):
    """The share of true links, in several blocks of queries; too few raise; without true links there is no share."""
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rows = [(10 * i, *x[1:]) for i, x in enumerate(rows_of(2))]
    df, want = spark.createDataFrame(rows, SCHEMA), by_rule(rows)
    asked = {i: n for i, (n, _) in want.items() if i % 100 == 0}
    out = vectors.audited(df).collect()
    assert {r["recall"] for r in out} == {sum(r["n_links"] for r in out if r["vec_id"] in asked) / sum(asked.values())}
    half = spark.createDataFrame([(i, n // 2) for i, (n, _) in want.items()], "vec_id long, n_links long")
    assert vectors.recall(df, half) == sum(n // 2 for n in asked.values()) / sum(asked.values())
    alone = df.where("vec_id < 30").selectExpr("vec_id", "embedding", "cast(vec_id as int) as label")
    assert {r["recall"] for r in vectors.audited(alone).collect()} == {None}
    monkeypatch.setattr(vectors, "near_duplicates", lambda rows, threshold: rows.selectExpr(
        "vec_id", "0L as n_links", "vec_id as component_id", "true as kept"))
    with pytest.raises(ValueError, match="recall"):
        vectors.audited(df)


def test_dense_spot_is_found_whole():
    r = np.random.default_rng(3)
    v = vectors.unit(np.concatenate([r.normal(size=(200, 32)), np.ones((400, 32)) + r.normal(size=(400, 32)) * 0.05]))
    hits = vectors.range_search(v, vectors.build_graph(v))
    true = v @ v.T >= vectors.THRESHOLD
    np.fill_diagonal(true, False)
    assert not (hits & ~true).any() and hits.sum() >= 0.98 * true.sum()
