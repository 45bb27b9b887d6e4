"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors of a label are one node with a count. A codebook fitted on a bounded sample (``SAMPLE`` nodes, chosen
by hash) cuts the space into cells; a node belongs to the shards of its two nearest cells, so shards
overlap. More nodes add codewords up to ``CELLS`` and then further levels of codewords for what the level before leaves,
so the codebook has a fixed size and shards stay small. A shard above ``MOST`` nodes, such as one dense spot, is dealt
into blocks, and every pair of its blocks is a task of its own; a task never gets more than two blocks.

In each task a graph is built: the nearest nodes and a few from afar, pruned robustly (a neighbour goes if another
is nearer to it by ``ALPHA``), except that near duplicates keep several of their like. The adjacency lists of all
tasks are united by node. Then every node is searched for from the medoids of its task over the united lists,
greedily with a beam, and from each hit the search goes on to its neighbours while they are within range. Hits are
verified by cosine in double precision. A pair that meets in several tasks counts in the first one only, so nothing
but counts and a spanning forest leaves a task. ``recall`` measures the ids divisible
by 100 against all rows; ``audited``, which the query calls, returns that figure and raises if it is below 0.9.

Nulls and edges: vectors that are null or zero or hold null or non-finite numbers, and those without a label, link
with nothing and stand for themselves; vectors of different lengths are not compared. Repeated rows count each
other as links. A null id is never a component's smallest unless it has no other; its row is kept if so.
Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import components, settle, shipped, thinned

THRESHOLD = 0.98
SAMPLE, CELLS, LEVELS = 4_000, 64, 4
TARGET, MOST = 1_000, 2_000
#: How many queries of an audit are compared at a time.
BLOCK = 1_000
NEAR, FAR, DEGREE, ALIKE, ALPHA, BEAM, MEDOIDS = 40, 12, 16, 10, 1.2, 24, 12


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision."""
    v = np.asarray(v, np.float64)
    if not v.size:
        return v
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def k_means(v: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    centres = v[:: max(1, len(v) // k)][:k].copy()
    for _ in range(rounds):
        near = (v @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = v[near == c].mean(0)
    return centres


def codebooks(sample: list, count: int) -> dict[int, list[np.ndarray]]:
    """For each vector length, codewords by level for ``count`` nodes in the largest label."""
    books: dict[int, list[np.ndarray]] = {}
    sizes = sorted({len(v) for v in sample})
    for size in sizes:
        rest, left, books[size] = unit([v for v in sample if len(v) == size]), 2 * count / TARGET, []
        while left > 1 and len(books[size]) < LEVELS and len(rest) > 1:
            k = int(min(CELLS, max(2, np.ceil(left)), len(rest)))
            centres = k_means(rest, k)
            books[size].append(centres)
            near = (rest @ centres.T - (centres ** 2).sum(1) / 2).argmax(1)
            rest, left = rest - centres[near], left * 2 / k if k < left else 0
    return books


def cells(v: np.ndarray, book: list[np.ndarray]) -> list[list[int]]:
    """For each unit vector, the numbers of its cells: the two nearest codewords on each level."""
    rows, rest, code = np.arange(len(v)), v, np.ones(len(v), np.int64)
    for centres in book:
        order = np.argsort(-(rest @ centres.T - (centres ** 2).sum(1) / 2), 1, kind="stable")[:, :2]
        rows, code = np.repeat(rows, order.shape[1]), np.repeat(code, order.shape[1]) * (CELLS + 1) + order.ravel()
        rest = np.repeat(rest, order.shape[1], 0) - centres[order.ravel()]
    out: list[list[int]] = [[] for _ in range(len(v))]
    for r, c in zip(rows, code, strict=True):
        out[r].append(int(c))
    return out


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def build_graph(v: np.ndarray, threshold: float = THRESHOLD) -> list[np.ndarray]:
    """Neighbours of each row: pruned robustly, near duplicates kept besides, and made mutual."""
    n = len(v)
    pools: list[set[int]] = [set() for _ in range(n)]
    for a in range(0, n, 512):
        sims = v[a:a + 512] @ v.T
        sims[np.arange(len(sims)), np.arange(a, a + len(sims))] = -2
        top = min(NEAR, n - 1)
        near = np.argpartition(-sims, top - 1, 1)[:, :top] if top else np.zeros((len(sims), 0), np.int64)
        for i, row in enumerate(sims):
            me = a + i
            far = (mix(np.uint64(me * 131) + np.arange(FAR, dtype=np.uint64)) % np.uint64(n)).astype(np.int64)
            pool = np.unique(np.concatenate([near[i], far]))
            pool = pool[pool != me]
            pool = pool[np.argsort(-row[pool], kind="stable")]
            alike = np.flatnonzero(row >= threshold)
            kept = list(pool[:ALIKE][row[pool[:ALIKE]] >= threshold])
            if len(alike) > ALIKE:
                kept += list(alike[(mix(np.uint64(me * 137) + np.arange(6, dtype=np.uint64)) % np.uint64(len(alike))).astype(np.int64)])
            distance = 2 - 2 * row[pool]
            between = 2 - 2 * v[pool] @ v[pool].T
            alive = np.ones(len(pool), bool)
            for p in range(len(pool)):
                if len(kept) >= DEGREE + ALIKE:
                    break
                if alive[p]:
                    kept.append(pool[p])
                    alive &= ~(ALPHA * between[p] <= distance)
            pools[me] |= {int(x) for x in kept}
    for me in range(n):
        for other in list(pools[me]):
            if len(pools[other]) < 3 * DEGREE:
                pools[other].add(me)
    return [np.array(sorted(p), np.int64) for p in pools]


def medoids(v: np.ndarray) -> np.ndarray:
    """Nodes nearest to the means of parts around points far from each other."""
    seeds, best = [int((v @ v.mean(0)).argmax())], np.full(len(v), -2.0)
    while len(seeds) < min(MEDOIDS, len(v)):
        best = np.maximum(best, v @ v[seeds[-1]])
        seeds.append(int(best.argmin()))
    part = (v @ v[seeds].T).argmax(1)
    out = {int(np.flatnonzero(part == p)[(v[part == p] @ v[part == p].mean(0)).argmax()]) for p in np.unique(part)}
    return np.array(sorted(out | {seeds[0]}), np.int64)


def range_search(v: np.ndarray, lists: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Boolean matrix of the pairs that the search finds within range."""
    n = len(v)
    width = max([1, *map(len, lists)])
    table = np.full((n, width), -1, np.int64)
    for i, x in enumerate(lists):
        table[i, :len(x)] = x
    seen, hits = np.zeros((n, n), bool), np.zeros((n, n), bool)
    rows, start = np.arange(n), medoids(v)
    ids = np.tile(start, (n, 1))
    sims = v @ v[start].T
    seen[:, start] = True
    hits[:, start] = sims >= threshold
    open_ = np.ones_like(sims, bool)
    while True:
        pick = np.where(open_, sims, -3).argmax(1)
        busy = np.flatnonzero(open_[rows, pick])
        if not len(busy):
            break
        open_[busy, pick[busy]] = False
        near = table[ids[busy, pick[busy]]]
        fresh = (near >= 0) & ~seen[busy[:, None], near]
        q, c = np.nonzero(fresh)
        who, what = busy[q], near[q, c]
        s = np.einsum("ij,ij->i", v[who], v[what])
        seen[who, what] = True
        hits[who, what] = s >= threshold
        grown = np.full((n, width), -3.0)
        grown[who, c] = s
        more = np.zeros((n, width), np.int64)
        more[who, c] = what
        sims, ids = np.concatenate([sims, grown], 1), np.concatenate([ids, more], 1)
        open_ = np.concatenate([open_, grown > -3], 1)
        if sims.shape[1] > BEAM:
            top = np.argpartition(-sims, BEAM - 1, 1)[:, :BEAM]
            sims, ids, open_ = (x[rows[:, None], top] for x in (sims, ids, open_))
    q, node = np.nonzero(hits)
    while len(q):
        new_q, new_node = [], []
        for a in range(0, len(q), 50_000):
            near = table[node[a:a + 50_000]]
            who = np.repeat(q[a:a + 50_000], width)[near.ravel() >= 0]
            what = near.ravel()[near.ravel() >= 0]
            unseen = ~seen[who, what]
            pairs = np.unique(who[unseen] * n + what[unseen])
            who, what = pairs // n, pairs % n
            seen[who, what] = True
            good = np.einsum("ij,ij->i", v[who], v[what]) >= threshold
            hits[who[good], what[good]] = True
            new_q.append(who[good])
            new_node.append(what[good])
        q, node = np.concatenate(new_q), np.concatenate(new_node)
    hits |= hits.T
    hits[rows, rows] = False
    return hits


def forest(hits: np.ndarray) -> np.ndarray:
    """For each row, the first row of its component."""
    root = np.arange(len(hits))
    while True:
        best = root.copy()
        for a in range(0, len(hits), 512):
            best[a:a + 512] = np.minimum(best[a:a + 512], np.where(hits[a:a + 512], root[None, :], len(hits)).min(1, initial=len(hits)))
        best = best[best]
        if (best == root).all():
            return root
        root = best


def members(nodes: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """node, label, size, v, n, shards: each node with the sorted numbers of its cells."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["v"].map(len)
            shards = pd.Series([[0]] * len(batch), index=batch.index)
            for size in sizes.unique():
                at = batch.index[sizes == size]
                found = cells(unit(np.stack(batch["v"][at].to_list())), books.get(size, []))
                for i, c in zip(at, found, strict=True):
                    shards[i] = sorted(set(c))
            yield batch.assign(shards=shards)

    return nodes.select("node", "label", "v", "n").mapInPandas(run, f"node long, label {nodes.schema['label'].dataType.simpleString()}, v array<double>, n long, shards array<long>")


def tasks_of(rows: DataFrame) -> DataFrame:
    """The members of each task: label, size, shard, x, y (two blocks, x <= y) and the member's own block."""
    each = rows.withColumn("size", F.size("v")).withColumn("shard", F.explode("shards"))
    counts = each.groupBy("label", "size", "shard").agg(F.ceil(F.count("*") / MOST).cast("int").alias("blocks"))
    placed = each.join(counts, ["label", "size", "shard"]).withColumn("block", F.pmod(F.xxhash64("node", "shard"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = placed.select("*", others).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    return placed.select(F.struct("label", "size", "shard", "x", "y").alias("task"), "node", "v", "n", "shards", "block")


def with_vectors(rows: DataFrame) -> DataFrame:
    """vec_id, label, v and whether the row can link (ok)."""
    vec = F.col("embedding").cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("label").isNotNull() & vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0)
    return rows.select("vec_id", "label", vec.alias("v"), F.coalesce(usable, F.lit(False)).alias("ok"))


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``rows`` (vec_id, embedding, label)."""
    rows = with_vectors(rows)
    rows = rows.withColumn("node", F.when(F.col("ok"), F.xxhash64("label", "v")))
    nodes = settle(rows.where("ok").groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("least")))
    sample = thinned(nodes, F.col("node"), SAMPLE).orderBy(F.xxhash64("node", F.lit("sample"))).limit(SAMPLE).toPandas()["v"].tolist()
    largest = nodes.groupBy("label", F.size("v")).count().agg(F.max("count")).first()[0] or 0
    placed = settle(tasks_of(members(nodes, codebooks(sample, largest))))

    def build(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node")
        ids = block["node"].to_numpy()
        lists = build_graph(unit(np.stack(block["v"].to_list())), threshold)
        return pd.DataFrame({"node": ids, "near": [ids[x] for x in lists]})

    lists = placed.groupBy("task").applyInPandas(build, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("node")
        ids = block["node"].to_numpy()
        v = unit(np.stack(block["v"].to_list()))
        lists = []
        for near in block["near"]:
            near = np.asarray(near, np.int64)
            at = np.minimum(np.searchsorted(ids, near), len(ids) - 1)
            lists.append(np.unique(at[ids[at] == near]))
        hits = range_search(v, lists, threshold)
        task, own = block["task"].iloc[0], block["block"].to_numpy()
        shard, cross = task["shard"], task["x"] != task["y"]
        if cross:
            hits &= own[:, None] != own[None, :]
        root = forest(hits)
        counts = np.zeros(len(ids), np.int64)
        weight = block["n"].to_numpy(np.int64)
        earlier = [frozenset(s for s in shards if s < shard) for shards in block["shards"]]
        for i in np.flatnonzero(hits.any(1)):
            others = np.flatnonzero(hits[i])
            mine = earlier[i]
            counts[i] = sum(int(weight[j]) for j in others if not mine or mine.isdisjoint(earlier[j]))
        return pd.DataFrame({"node": ids, "links": counts, "root": ids[root]})

    found = settle(placed.join(united, "node").groupBy("task").applyInPandas(search, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = settle(components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    named = nodes.join(links, "node").join(groups, "node", "left").select(
        "node", "n", "least", "links", F.coalesce("component", "node").alias("grp"))
    least = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    of_node = named.join(least, "grp").select("node", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.where("ok").join(of_node, "node").select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def recall(rows: DataFrame, found: DataFrame, threshold: float = THRESHOLD, every: int = 100) -> float | None:
    """Share of the links of the ids divisible by ``every`` that ``found`` has, against all rows; None if they have none.

    The queries are dealt into blocks of about ``BLOCK``, which alone pass the driver; each task multiplies its rows with a block.
    """
    spark = rows.sparkSession
    plain = with_vectors(rows).where("ok").select("vec_id", "label", "v")
    deal = F.xxhash64(F.monotonically_increasing_id())
    asked = settle(plain.where(F.col("vec_id") % every == 0).withColumn("deal", deal))
    n = asked.count()
    blocks, hits = -(-n // BLOCK), 0
    for k in range(blocks):
        mine = asked.where(F.pmod("deal", F.lit(blocks)) == k).toPandas()
        queries = {key: unit(np.stack(part["v"].to_list())) for key, part in mine.groupby(["label", mine["v"].map(len)])}
        shared = spark.sparkContext.broadcast(queries)

        def count(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for key, part in batch.groupby(["label", batch["v"].map(len)]):
                    if key in shared.value:
                        near = unit(np.stack(part["v"].to_list())) @ shared.value[key].T >= threshold
                        yield pd.DataFrame({"n": [int(near.sum())]})

        hits += plain.mapInPandas(count, "n long").agg(F.sum("n")).first()[0] or 0
        shared.unpersist()
    true = hits - n  # each query meets itself
    got = found.where(F.col("vec_id") % every == 0).agg(F.sum("n_links")).first()[0] or 0
    return got / true if true else None


def audited(rows: DataFrame, threshold: float = THRESHOLD, least: float = 0.9) -> DataFrame:
    """``near_duplicates`` with the recall of the ids divisible by 100, null without links; raises if it is below ``least``."""
    found = settle(near_duplicates(rows, threshold))
    share = recall(rows, found, threshold)
    if share is not None and share < least:
        raise ValueError(f"recall {share:.3f} is below {least}")
    return found.withColumn("recall", F.lit(share).cast("double"))


shipped(__name__)
