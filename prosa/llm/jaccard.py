"""N-gram Jaccard join by universe-partition pigeonhole, with exact verification.

A document is the set of its word shingles, as 64-bit hashes. Equal sets are one class; only classes are
joined. Sizes are cut into bands so wide that linked sets are in one band or in neighbouring ones. In a
band, linked sets differ in at most ``H`` shingles, so if the universe of shingles is cut into segments
with a budget of ``H + 1``, some segment agrees within its share: exactly (budget 1), or up to one shingle (budget 2,
found by the set itself and all sets with one shingle removed). For each band the kind of segment with the
lower cost is taken, from the number of classes there: signatures written against pairs expected by chance.
Segments in which a set has nothing are left out where the others already exhaust the budget.

Classes with a common signature are compared with the smallest of them. Components of what links are
one group; classes that met the same smallest class but are in different groups are then compared too,
in blocks inside tasks, groups against groups, as a pair inside one group can change nothing. So no list of
all pairs of a group is ever made, and no link between groups is lost.

Sets move only for pairs that can link. A set's sketch is how many of its shingles fall into each of some cells, two to
four on average; two sets have at most the smaller count of each cell in common. A pair whose sketches leave too little
for the threshold can't link, so nothing is lost by that.

Nulls and edges: a null text is empty; a text without words has an empty set, size 0 and links with nothing; with
fewer words than a shingle has, the whole sequence is the one shingle. Null ids are kept and never are a
component's smallest id unless it has no other. Repeated rows each get a row. Long texts are handled
whole. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from math import exp

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prosa.llm.common import components, settle, shipped, small_batches, word_hashes

WORDS, PART, WHOLE = 4, 85, 100
#: Relative costs of writing a signature and of checking a pair.
SIGNATURE, PAIR = 1.0, 40.0
#: Assumed chance that a shingle of one set is in another set of its band.
COMMON = 0.02
BLOCK = 256
#: Bits of the prefilter for the sets that are fetched for verification.
FILTER = 1 << 22
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * ODD[4]
    x = (x ^ (x >> np.uint64(29))) * ODD[0]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    data = (text or "").encode("utf-8", "replace").lower()
    h, _ = word_hashes(data)
    if not len(h):
        return np.zeros(0, np.uint64)
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(data.split()), seed=len(h))], np.uint64)
    n = len(h) - words + 1
    out = h[:n] * ODD[0]
    for k in range(1, words):
        out = mixed(out) + h[k:n + k] * ODD[1 + (k - 1) % 3]
    return np.unique(mixed(out))


def sketch_of(s: np.ndarray) -> bytes | None:
    """How many shingles fall into each cell, by their first bits, a byte a cell; None if a count doesn't fit."""
    bits = max(len(s).bit_length() - 2, 1)
    counts = np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    return counts.astype(np.uint8).tobytes() if counts.max() < 256 else None


def may_link(left: list[bytes | None], right: list[bytes | None], part: int, whole: int) -> np.ndarray:
    """Boolean matrix: which sets of the two lists can link, by their sketches. Where one has none, they can."""
    out = np.zeros((len(left), len(right)), bool)
    for side, sketches in ((out, left), (out.T, right)):
        side[[i for i, s in enumerate(sketches) if s is None]] = True

    def at_level(sketches: list[bytes | None], cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sketches with so many cells, and with twice as many, folded; which they are; which are folded."""
        which = [i for i, s in enumerate(sketches) if s is not None and len(s) in (cells, 2 * cells)]
        counts = [np.frombuffer(sketches[i], np.uint8).reshape(cells, -1).sum(axis=1, dtype=np.int16) for i in which]
        folded = np.array([len(sketches[i]) > cells for i in which], bool)
        return np.array(counts, np.int16).reshape(len(which), cells), np.array(which, np.int64), folded

    # Linked sets differ by less than half, so their numbers of cells do by a factor of two at most.
    levels = {len(s) for s in chain(left, right) if s is not None} if 2 * part > whole else set()
    if not levels:
        out[:] |= 2 * part <= whole
    for cells in sorted(levels):
        (a, ia, fa), (b, ib, fb) = at_level(left, cells), at_level(right, cells)
        if not len(a) or not len(b):
            continue
        n, m = a.sum(axis=1, dtype=np.int64), b.sum(axis=1, dtype=np.int64)
        for k in range(len(a)):
            near = np.flatnonzero((whole * np.minimum(n[k], m) >= part * np.maximum(n[k], m)) & ~(fa[k] & fb))
            if len(near):
                common = np.minimum(a[k], b[near]).sum(axis=1, dtype=np.int64)
                out[ia[k], ib[near]] |= whole * common >= part * (n[k] + m[near] - common)
    return out


def class_of(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def bands(part: int, whole: int, largest: int) -> list[int]:
    """First size of each band, up to one beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * whole // part + 1)
    return [*edges, edges[-1] * whole // part + 1]


def rarely(mean: float, share: float) -> int:
    """The smallest k so that a Poisson count with this mean is above k with a probability of at most ``share``."""
    k, term = 0, exp(-mean)
    tail = 1 - term
    while tail > share and k < 10 * mean + 60:
        k += 1
        term *= mean / k
        tail -= term
    return k


def allot(smaller: int, classes: int, part: int, whole: int) -> tuple[int, int, int]:
    """(H, segments of budget 2, segments of budget 1) for pairs whose smaller set has up to ``smaller`` shingles.

    Spare segments are added so that about one set in all lacks the budget without its empty segments.
    """
    most = smaller + smaller * whole // part
    h = most * (whole - part) // (whole + part)
    if h == 0:
        return 0, 0, 0
    mean = smaller / (h + 1)

    def cost(two: int) -> float:
        one = h + 1 - 2 * two
        chance = one * COMMON ** mean + two * COMMON ** (2 * mean) * (1 + 2 * mean / COMMON)
        return SIGNATURE * classes * (one + two * (1 + 2 * mean)) + PAIR * classes ** 2 / 2 * chance

    two = min((0, (h + 1) // 2), key=cost)
    one = h + 1 - 2 * two
    empty = one * exp(-mean) + 2 * two * exp(-2 * mean) * (1 + 2 * mean)
    return h, two, one + rarely(empty, 1 / max(classes, 2))


def signatures(s: np.ndarray, band: int, plan: tuple[int, int, int]) -> np.ndarray:
    """Hashes of the set's parts under the plan of a band."""
    h, two, one = plan
    slots = 2 * two + one
    spread = mixed(s ^ ODD[2])
    slot = ((spread >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
    segment = np.where(slot < 2 * two, slot // np.uint64(2), slot - np.uint64(two)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    value, at = mixed(s * ODD[3] + ODD[1])[order], segment[order]
    bounds = np.searchsorted(at, np.arange(two + one + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    sums, counts = total[bounds[1:]] - total[bounds[:-1]], np.diff(bounds)
    useful = 2 * (counts[:two] >= 2).sum() + (counts[two:] >= 1).sum()
    segments = np.arange(two + one)
    less = at < two
    sums = np.concatenate([sums, sums[at[less]] - value[less]])
    left = np.concatenate([counts, counts[at[less]] - 1])
    segments = np.concatenate([segments, at[less]])
    if useful > h:
        sums, segments = sums[left > 0], segments[left > 0]
    return np.unique(mixed(sums + mixed((segments + (band << 24)).astype(np.uint64) * ODD[0]))).view(np.int64)


def classes_of(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, th, n_shingles, cls, sketch: th is a hash of the text, cls is null for an empty set."""
    rows = small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("th")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "th": batch["th"], "n_shingles": [len(s) for s in sets],
                                "cls": pd.array([class_of(s) if len(s) else None for s in sets], "Int64"),
                                "sketch": [sketch_of(s) if len(s) else None for s in sets]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, th long, n_shingles long, cls long, sketch binary")


def signature_rows(docs: DataFrame, plans: dict[int, tuple[int, int, int]], edges: list[int], words: int) -> DataFrame:
    """key, cls: a class that a task has met before is not written again by it."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met = set()
        for batch in batches:
            keys, owners, held = [], [], 0
            for text in batch["text"]:
                s = shingles(text, words)
                if not len(s) or (c := class_of(s)) in met:
                    continue
                met.add(c)
                band = int(np.searchsorted(edges, len(s), side="right")) - 1
                for b in (band, band - 1):
                    if plans.get(b, (0,))[0]:
                        keys.append(signatures(s, b, plans[b]))
                        owners.append(np.full(len(keys[-1]), c, np.int64))
                        held += len(keys[-1])
                if held > 500_000:
                    yield pd.DataFrame({"key": np.concatenate(keys), "cls": np.concatenate(owners)})
                    keys, owners, held = [], [], 0
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "cls": np.concatenate(owners)})

    return small_batches(docs.select("text")).mapInPandas(run, "key long, cls long")


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls, items: the sets of the ``wanted`` classes (cls), one row each, stored.

    A bitmap of fixed size keeps most other sets from being written; a join removes the rest.
    """
    bit = F.col("cls").bitwiseAND(F.lit(FILTER - 1))
    cells = wanted.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).toPandas()
    bitmap = np.zeros(FILTER // 64, np.int64)
    bitmap[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met, bits = set(), shared.value
        for batch in batches:
            out, held = {"cls": [], "items": []}, 0
            for text in batch["text"]:
                s = shingles(text, words)
                if not len(s) or (c := class_of(s)) in met:
                    continue
                b = c & (FILTER - 1)
                if int(bits[b >> 6]) >> (b & 63) & 1:
                    met.add(c)
                    out["cls"].append(c)
                    out["items"].append(s.view(np.int64))
                    held += len(s)
                    if held > 2_000_000:
                        yield pd.DataFrame(out)
                        out, held = {"cls": [], "items": []}, 0
            if out["cls"]:
                yield pd.DataFrame(out)

    rows = small_batches(docs.select("text")).mapInPandas(run, "cls long, items array<long>")
    return settle(rows.join(wanted, "cls", "left_semi").groupBy("cls").agg(F.any_value("items").alias("items")))


def linked_in_block(left: list[np.ndarray], right: list[np.ndarray], part: int, whole: int) -> np.ndarray:
    """Boolean matrix: which sets of the two lists link. Shingles that stand in one set only are left out."""
    n, sets = len(left), [*left, *right]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    common = np.zeros((n, len(right)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[rows[a:b], column[a:b] - start] = 1
        common += dense[:n] @ dense[n:].T
    common = np.rint(common).astype(np.int64)
    sizes = np.array([len(s) for s in sets])
    return whole * common >= part * (sizes[:n, None] + sizes[None, n:] - common)


def that_may_link(pairs: DataFrame, sketches: DataFrame, part: int, whole: int) -> DataFrame:
    """The ``pairs`` (leader, cls) that can link by their sketches."""
    def test(one: pd.Series, other: pd.Series) -> pd.Series:
        return pd.Series([may_link([a], [b], part, whole)[0, 0] for a, b in zip(one, other, strict=True)], dtype=bool)

    both = pairs.join(sketches, "cls").join(sketches.select(F.col("cls").alias("leader"), F.col("sketch").alias("other")), "leader")
    return both.where(F.pandas_udf(test, "boolean")("sketch", "other")).select("leader", "cls")


def links_between(docs: DataFrame, pairs: DataFrame, groups: DataFrame, sketches: DataFrame, words: int, part: int, whole: int) -> DataFrame | None:
    """a, b: links between classes that met the same leader and are in different groups.

    ``pairs``: leader, cls. ``groups``: node, component. Members of a leader are dealt into blocks: groups of more
    than ``BLOCK`` members into blocks of their own, the others together. A task gets two blocks, never two
    of one group. It first compares sketches: sets move only for members that can link with another group there. None: no links.
    """
    grouped = pairs.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select(
        "leader", "cls", F.coalesce("component", "cls").alias("grp"))
    sizes = grouped.groupBy("leader", "grp").agg(F.count("*").alias("n"))
    per_leader = sizes.groupBy("leader").agg(
        F.count("*").alias("groups"), F.sum(F.when(F.col("n") <= BLOCK, F.col("n")).otherwise(0)).alias("small"))
    sizes = sizes.join(per_leader.where("groups > 1"), "leader")
    own = F.col("n") > BLOCK
    pool = F.pmod(F.xxhash64("grp"), F.greatest(F.lit(1), F.ceil(F.col("small") / BLOCK)))
    spread = F.pmod(F.xxhash64("cls", F.lit(1)), F.ceil(F.col("n") / BLOCK))
    placed = grouped.join(sizes, ["leader", "grp"]).select(
        "leader", "cls", "grp", F.when(own, F.col("grp")).alias("big"), F.when(own, spread).otherwise(pool).alias("nr"))
    placed = settle(placed)
    held = placed.select("leader", "big", "nr").distinct()
    left, right = (held.select("leader", F.struct(F.coalesce("big", F.lit(0)).alias("big"), F.col("big").isNull().alias("pool"), "nr").alias(x))
                   for x in ("x", "y"))
    both = left.join(right, "leader").where("x <= y and not (x.pool = false and y.pool = false and x.big = y.big)")
    mine = F.struct(F.coalesce("big", F.lit(0)).alias("big"), F.col("big").isNull().alias("pool"), "nr")
    mine = placed.select("leader", "cls", "grp", mine.alias("z"))
    first = mine.join(both.withColumn("z", F.col("x")), ["leader", "z"]).select("leader", "x", "y", "cls", "grp", F.lit(True).alias("first"))
    second = mine.join(both.where("x <> y").withColumn("z", F.col("y")), ["leader", "z"]).select("leader", "x", "y", "cls", "grp", F.lit(False).alias("first"))
    rows = first.unionByName(second).withColumn("task", F.xxhash64("leader", "x", "y")).drop("leader", "x", "y")

    def rivals(block: pd.DataFrame) -> pd.DataFrame:
        one, two = block[block["first"]], block[~block["first"]]
        alone = not len(two)
        two = one if alone else two
        hit = may_link(list(one["sketch"]), list(two["sketch"]), part, whole)
        hit &= one["grp"].to_numpy()[:, None] != two["grp"].to_numpy()[None, :]
        left, right = hit.any(axis=1), hit.any(axis=0)
        stay = one[left | right] if alone else pd.concat([one[left], two[right]])
        return stay[["task", "cls", "grp", "first"]]

    rows = settle(rows.join(sketches, "cls").groupBy("task").applyInPandas(rivals, "task long, cls long, grp long, first boolean"))
    if rows.isEmpty():
        return None
    rows = rows.join(sets_of(docs, rows.select("cls").distinct(), words), "cls")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        one = block[block["first"]]
        two = block[~block["first"]]
        two = two if len(two) else one
        out = {"a": [], "b": []}
        if len(one) and len(two):
            hit = linked_in_block(list(one["items"]), list(two["items"]), part, whole)
            ga, gb = one["grp"].to_numpy(), two["grp"].to_numpy()
            hit &= ga[:, None] != gb[None, :]
            ca, cb = one["cls"].to_numpy(), two["cls"].to_numpy()
            known = set()
            for i, j in zip(*np.nonzero(hit), strict=True):
                if (ga[i], gb[j]) not in known:
                    known |= {(ga[i], gb[j]), (gb[j], ga[i])}
                    out["a"].append(ca[i])
                    out["b"].append(cb[j])
        return pd.DataFrame(out, dtype="int64")

    return rows.groupBy("task").applyInPandas(compare, "a long, b long")


def grouped(docs: DataFrame, words: int = WORDS, part: int = PART, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, th, n_shingles, cls) and groups (cls, grp, component_id) of the classes."""
    rows = settle(classes_of(docs, words))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.first("n_shingles").alias("n"), F.min("doc_id").alias("least"))
    largest = classes.agg(F.max("n")).first()[0] or 0
    edges = bands(part, whole, largest)
    cuts = F.array(*map(F.lit, edges))
    band = F.size(F.filter(cuts, lambda e: e <= F.col("n"))) - 1
    count = {r["band"]: r["c"] for r in classes.groupBy(band.alias("band")).agg(F.count("*").alias("c")).collect()}
    plans = {b: allot(edges[b + 1] - 1, count.get(b, 0) + count.get(b + 1, 0), part, whole)
             for b in range(len(edges) - 1) if count.get(b, 0)}
    keys = signature_rows(docs, plans, edges, words)
    leader = F.min("cls").over(Window.partitionBy("key"))
    pairs = settle(keys.withColumn("leader", leader).where("cls <> leader").select("leader", "cls").distinct())
    wanted = pairs.select("cls").union(pairs.select(F.col("leader").alias("cls"))).distinct()
    sketches = settle(rows.select("cls", "sketch").join(wanted, "cls", "left_semi").groupBy("cls").agg(F.any_value("sketch").alias("sketch")))
    near = settle(that_may_link(pairs, sketches, part, whole))
    sets = sets_of(docs, near.select("cls").union(near.select(F.col("leader").alias("cls"))).distinct(), words)
    tested = near.join(sets, "cls").join(sets.select(F.col("cls").alias("leader"), F.col("items").alias("other")), "leader")
    common = F.size(F.array_intersect("items", "other"))
    linked = tested.where(whole * common >= part * (F.size("items") + F.size("other") - common))
    links = settle(linked.select(F.col("leader").alias("a"), F.col("cls").alias("b")))
    groups = settle(components(links))
    more = links_between(docs, pairs, groups, sketches, words, part, whole)
    if more is not None and not (more := settle(more)).isEmpty():
        groups = settle(components(links.unionByName(more)))
    named = classes.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "least", F.coalesce("component", "cls").alias("grp"))
    least = named.groupBy("grp").agg(F.min("least").alias("component_id"))
    return rows, named.join(least, "grp").select("cls", "grp", "component_id")


def jaccard_join(docs: DataFrame, words: int = WORDS, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: links are sets with
    ``whole * common >= part * union``."""
    rows, groups = grouped(docs, words, part, whole)
    full = rows.where("cls is not null").join(groups, "cls").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("cls is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def representatives(docs: DataFrame, words: int = WORDS, part: int = PART, whole: int = WHOLE) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one of each group stays, that with the smallest id, then text hash.

    Documents without words are in no group and stay.
    """
    rows, groups = grouped(docs, words, part, whole)
    full = rows.where("cls is not null").join(groups, "cls")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    chosen = full.groupBy("grp").agg(F.min(place).alias("p")).select("p.doc_id", "p.th")
    chosen = chosen.union(rows.where("cls is null").select("doc_id", "th").distinct())
    copies = rows.groupBy("doc_id", "th", "cls").agg(F.count("*").alias("n"))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "th")
    chosen = chosen.withColumn("_key", key).select("_key").join(
        copies.select(key.alias("_key"), F.when((F.col("n") > 1) & F.col("cls").isNotNull(), 1).otherwise(0).alias("_many")), "_key")
    chosen = settle(chosen.distinct())
    keyed = docs.withColumn("_key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), F.xxhash64("text")))
    single = keyed.join(chosen.where("_many = 0"), "_key", "left_semi")
    several = keyed.join(chosen.where("_many = 1"), "_key", "left_semi").dropDuplicates(["_key"])
    return single.unionByName(several).select(docs.columns)


shipped(__name__)
