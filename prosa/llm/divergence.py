"""Source divergence audit: how far the term frequencies of a language's sources lie apart.

A group is a language and a source. A language keeps the terms that enough of its documents hold. Each group gives each kept
term a price ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, where ``N`` sums the group's counts over the
``V`` kept terms; all of it is integer arithmetic. The distance of two groups is the sum of the differences of their
prices over all kept terms, most of which neither or only one of them has.

The matrix of groups by terms is dealt into strips of columns by a hash of the term, and each strip, for each pair of blocks of
rows, is a k^2-tree (k = 2): every node holds for its four quadrants where their nodes are, or that all their
counts are zero. The trees of two rows are walked down together, for all pairs of row ranges at once. Where both
quadrants are zero, nothing below is visited: each of its columns costs the difference of the two groups' prices of
a term they don't have. Only leaves, tiles of 8 groups and 8 terms of which one has a count, are compared cell by cell.

Counting is one pass: each task adds up its documents' terms by group and sends each term once, so a source with most
of the rows costs no more rows than another. Tasks hold a strip of about 1,024 terms and two blocks of 256 groups; the
results, all pairs of a language's sources, are what was asked for.

Nulls and edges: a null text, language or source is an empty one. A group without terms is a group; a language without kept terms
has distances 0 and no terms. Rows that repeat an id are documents of their own. Sums are exact up to 9 * 10^13
terms in a language. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosa.llm.common import scratch, shipped, small_batches

LEAST_DOCS, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Terms in a strip (about), groups in a block, rows and columns of a leaf, pairs of leaves compared at a time.
STRIP, BLOCK, LEAF, LEAVES = 1024, 256, 8, 4096
#: Different terms that a task adds up before it sends them on.
HELD = 500_000
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text
  FROM documents),
found AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS item FROM docs),
kept AS (SELECT lang, item, count(*) AS total FROM found GROUP BY lang, item HAVING count(DISTINCT r) >= {LEAST_DOCS}),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v, sum(total)::BIGINT AS n FROM kept GROUP BY lang),
cells AS (SELECT lang, source, item, count(*) AS n FROM found SEMI JOIN kept USING (lang, item) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n)::BIGINT AS n FROM cells GROUP BY ALL),
grid AS (
  SELECT g.lang, g.source, k.item, coalesce(c.n, 0) AS count, k.total,
         1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {SMOOTH}) // (coalesce(s.n, 0) + {SMOOTH} * z.v))::BIGINT AS p,
         1 + ({SCALE}::HUGEINT * (k.total + {SMOOTH}) // (z.n + {SMOOTH} * z.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN sizes z USING (lang)
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.item = k.item),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN grid x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN grid y ON y.lang = b.lang AND y.source = b.source AND y.item = x.item
  GROUP BY a.lang, a.source, b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
         row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT * FROM (SELECT lang, source, 'term', item, p - q, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, item) AS rank
                 FROM grid WHERE count > 0 AND p > q) WHERE rank <= {TOP})
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked
"""


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_LETTERS).split()


def counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it)."""
    rows = small_batches(docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, d) in held.items():
                if n:
                    yield pd.DataFrame({"lang": [lang] * len(n), "source": [source] * len(n), "term": [t.decode("utf-8", "replace") for t in n],
                                        "n": list(n.values()), "docs": [d[t] for t in n]})
            held.clear()

        for batch in batches:
            for lang, source, text in batch.itertuples(index=False):
                found = terms(text)
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(found)
                d.update(set(found))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from sent()
        yield from sent()

    found = rows.mapInPandas(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def price(count: Column, n: Column, v: Column, scale: int, smooth: int) -> Column:
    """The price of a term, in decimals as the product does not fit a long."""
    above = (count + F.lit(smooth)).cast("decimal(20,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.lit(1) + F.call_function("div", above, (n + F.lit(smooth) * v).cast("decimal(20,0)"))


class Tree:
    """A k^2-tree (k = 2) over tiles. ``below[l]`` gives for each node of level ``l`` the nodes of its quadrants on the
    level below, -1 for a quadrant without counts; the nodes of level 0 are the tiles."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, height: int):
        self.below: list[np.ndarray] = [np.zeros((0, 2, 2), np.int64)]
        codes = rows << 32 | cols
        for _ in range(height):
            r, c = codes >> 32, codes & 0xFFFFFFFF
            above, node = np.unique((r >> 1) << 32 | c >> 1, return_inverse=True)
            below = np.full((len(above), 2, 2), -1, np.int64)
            below[node, r & 1, c & 1] = np.arange(len(codes))
            self.below.append(below)
            codes = above
        self.root = 0 if len(codes) else -1


def step_down(tree: Tree, level: int, front: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The pairs of quadrants of a level's pairs of nodes. A front is: node of the first row range and of the second (-1:
    no counts), number of the first range, of the second, of the column range. The first never follows the second."""
    x, y, a, b, c = front
    below = np.concatenate([tree.below[level], np.full((1, 2, 2), -1, np.int64)])  # -1 finds the last
    parts = [(below[x, i, k], below[y, j, k], 2 * a + i, 2 * b + j, 2 * c + k)
             for i in (0, 1) for j in (0, 1) for k in (0, 1)]
    out = [np.concatenate(p) for p in zip(*parts, strict=True)]
    ordered = out[2] <= out[3]
    return tuple(p[ordered] for p in out)


def distances(row: np.ndarray, col: np.ndarray, p: np.ndarray, zero: np.ndarray, width: int) -> np.ndarray:
    """Sum over ``width`` columns of the differences of prices, for all pairs of rows (first < second). ``p``: prices of the cells
    (row, col) with a count; ``zero``: each row's price of a column without."""
    n = len(zero)
    tile_rows, tile_cols = -(-n // LEAF), -(-width // LEAF)
    height = max(tile_rows - 1, tile_cols - 1, 0).bit_length()
    codes, tile = np.unique((row // LEAF) << 32 | col // LEAF, return_inverse=True)
    tr, tc = codes >> 32, codes & 0xFFFFFFFF
    padded = np.zeros(tile_rows * LEAF, np.int64)
    padded[:n] = zero
    real = (np.arange(tile_cols * LEAF) < width).reshape(tile_cols, LEAF)
    empty = padded.reshape(tile_rows, LEAF)[:, :, None]
    tiles = np.concatenate([empty[tr] * real[tc][:, None, :], np.zeros((1, LEAF, LEAF), np.int64)])
    tiles[tile, row % LEAF, col % LEAF] = p

    out = np.zeros((tile_rows, tile_rows, LEAF, LEAF), np.int64)
    blank = np.zeros((tile_rows, tile_rows), np.int64)  # columns that both ranges lack
    tree = Tree(tr, tc, height)
    front = tuple(np.array([v], np.int64) for v in (tree.root, tree.root, 0, 0, 0))
    for level in range(height, -1, -1):
        x, y, a, b, c = front
        size = 1 << level
        inside = (b * size < tile_rows) & (c * size < tile_cols)
        nothing = inside & (x < 0) & (y < 0)
        if nothing.any():
            columns = np.clip(width - c * size * LEAF, 0, size * LEAF)
            grid = np.zeros((-(-tile_rows // size),) * 2, np.int64)
            np.add.at(grid, (a[nothing], b[nothing]), columns[nothing])
            blank += np.kron(grid, np.ones((size, size), np.int64))[:tile_rows, :tile_rows]
        front = tuple(v[inside & ~nothing] for v in front)
        if level:
            front = step_down(tree, level, front)
    for k in range(0, len(front[0]), LEAVES):
        x, y, a, b, c = (v[k:k + LEAVES] for v in front)
        left, right = (np.where((t < 0)[:, None, None], empty[r] * real[c][:, None, :], tiles[t]) for t, r in ((x, a), (y, b)))
        apart = sum(np.abs(left[:, :, None, j] - right[:, None, :, j]) for j in range(LEAF))
        np.add.at(out, (a, b), apart)
    out += blank[:, :, None, None] * np.abs(empty[:, None, :, :] - padded.reshape(1, tile_rows, 1, LEAF))
    return out.transpose(0, 2, 1, 3).reshape(tile_rows * LEAF, tile_rows * LEAF)[:n, :n]


def strip_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """One strip and pair of blocks: a row for each pair of groups."""
    pdf = pdf.sort_values("gid", ignore_index=True)
    cells = [np.zeros((0, 2), np.int64) if c is None else np.array([(x["col"], x["p"]) for x in c], np.int64).reshape(-1, 2) for c in pdf["cells"]]
    flat = np.concatenate(cells)
    at = np.repeat(np.arange(len(pdf)), [len(c) for c in cells])
    first = pdf.iloc[0]
    total = distances(at, flat[:, 0], flat[:, 1], pdf["zero"].to_numpy(np.int64), int(first["width"]))
    block, gid = pdf["block"].to_numpy(), pdf["gid"].to_numpy()
    i, j = np.nonzero((block[:, None] == first["low"]) & (block[None, :] == first["high"]) & (gid[:, None] < gid[None, :]))
    return pd.DataFrame({"lang": np.full(len(i), first["lang"], object), "x": gid[i], "y": gid[j], "value": total[i, j]})


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, scale: int = SCALE, smooth: int = SMOOTH) -> DataFrame:
    """lang, source, part, item, value, rank: ``pair`` rows compare a group with each other source of its language, ``term`` rows
    are the ``top`` terms a group uses more than its language."""
    spark = docs.sparkSession
    folder = scratch(spark, "terms")
    counts(docs).write.parquet(folder)
    found = spark.read.parquet(folder)

    totals = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= least_docs)
    sizes = totals.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    strips = F.greatest(F.ceil(F.col("v") / F.lit(STRIP)), F.lit(1)).cast("int")
    strip = F.pmod(F.xxhash64("term"), strips).cast("int")
    col = F.row_number().over(Window.partitionBy("lang", "strip").orderBy("term")) - 1
    # Dealt out by strip: the terms of a language, found together by the join, are not numbered together.
    kept = totals.drop("docs").join(sizes, "lang").withColumn("strip", strip).repartition("lang", "strip").withColumn("col", col)
    folder = scratch(spark, "cells")
    found.drop("docs").join(kept, ["lang", "term"]).write.parquet(folder)
    cells = spark.read.parquet(folder)

    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    none = F.lit(0).cast("long")
    groups = (groups.join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
              .select("lang", "source", F.coalesce("group_n", none).alias("group_n"), F.coalesce("v", none).alias("v"), "lang_n",
                      (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("gid")))
    folder = scratch(spark, "groups")
    groups.write.parquet(folder)  # one row a group
    groups = spark.read.parquet(folder)

    priced = cells.join(groups.select("lang", "source", "group_n", "gid"), ["lang", "source"]).withColumns({
        "p": price(F.col("n"), F.col("group_n"), F.col("v"), scale, smooth),
        "q": price(F.col("total"), F.col("lang_n"), F.col("v"), scale, smooth)})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = (priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top))

    rows = priced.groupBy("lang", "strip", "gid").agg(F.collect_list(F.struct("col", "p")).alias("cells"))
    widths = kept.groupBy("lang", "strip").agg(F.count("*").alias("width"))
    blocks = groups.groupBy("lang").agg(F.max(F.col("gid")).alias("last"))
    zero = F.when(F.col("v") > 0, price(none, F.col("group_n"), F.col("v"), scale, smooth)).otherwise(none)
    # Every group stands in every strip of its language, with or without counts there.
    every = (groups.select("lang", "gid", zero.alias("zero"), F.explode(F.sequence(F.lit(0), strips - 1)).alias("strip"))
             .join(widths, ["lang", "strip"], "left").withColumn("width", F.coalesce("width", none))
             .join(rows, ["lang", "strip", "gid"], "left")
             .withColumn("block", F.floor(F.col("gid") / F.lit(BLOCK)).cast("int")).join(blocks, "lang"))
    other = F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / F.lit(BLOCK)).cast("int")))
    dealt = every.withColumn("other", other).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    part = (dealt.select("lang", "strip", "low", "high", "block", "gid", "zero", "width", "cells").groupBy("lang", "strip", "low", "high")
            .applyInPandas(strip_pairs, "lang string, x int, y int, value long"))
    both = F.explode(F.array(F.struct(F.col("x").alias("gid"), F.col("y").alias("to")), F.struct(F.col("y").alias("gid"), F.col("x").alias("to"))))
    apart = part.groupBy("lang", "x", "y").agg(F.sum("value").alias("value")).select("lang", both.alias("e"), "value").select("lang", "e.*", "value")
    names = groups.select("lang", "gid", "source")
    pairs = (apart.join(names, ["lang", "gid"]).join(names.select("lang", F.col("gid").alias("to"), F.col("source").alias("item")), ["lang", "to"])
             .select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(best)))
    return pairs.unionByName(above)


shipped(__name__)
