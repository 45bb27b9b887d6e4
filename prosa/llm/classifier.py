"""Quality classifier: histogram gradient-boosted trees over document statistics, numpy only.

Statistics come from whole texts, one pass in Arrow batches. Trees are fitted on the driver on at most
``SAMPLE`` labelled rows, chosen by hashes of their id, so the fit does not grow with the
corpus; every document is scored. Fitted trees are flattened into three arrays, which all rows of a
batch walk down at once, one level per step.

Labels: of rows of one id the mean decides, 0.5 and above being 1; null labels and ids are left out. Without
labels every score is 0.5, with one class it is that class's share, smoothed. Null texts count as empty and
get a score; repeated rows get a row each; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import settle, shipped, small_batches, thinned

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST = 40, 4, 64, 0.2, 1.0, 20
THRESHOLD = 0.3
MARKS = b"#*$%&|<>!?.,;:\"'()-=_/@"


def statistics(text: str) -> list[float]:
    """What the trees see of a text: lengths, shares of characters, of words and of lines."""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n if raw else np.zeros(256)
    words = text.split()
    k = max(len(words), 1)
    lines = [x for x in text.split("\n") if x]
    lower = seen[97:123].sum()
    upper = seen[65:91].sum()
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / k, len(set(words)) / k,
        sum(map(eq, words, words[1:])) / k, sum(map(eq, words, words[2:])) / k, len(set(lines)) / max(len(lines), 1),
        len(words) / max(len(lines), 1), upper, lower, upper / (upper + lower + 1e-9), seen[48:58].sum(), seen[128:].sum(),
        seen[9:14].sum() + seen[32], max(map(len, words), default=0), *seen[list(MARKS)]]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, x: the statistics of every document."""
    rows = small_batches(docs.select("doc_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "x": [statistics(t or "") for t in batch["text"]]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")


class Trees:
    """Boosted trees of one depth in arrays: feature and threshold by tree and node, value by tree and leaf."""

    def __init__(self, depth: int = DEPTH):
        self.depth, self.start = depth, 0.0
        self.feature = np.zeros((0, 2 ** depth - 1), np.int64)
        self.threshold = np.zeros((0, 2 ** depth - 1))
        self.value = np.zeros((0, 2 ** depth))

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2 ** self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Trees:
    """Histograms of gradients per node, feature and bin; each level of a tree is split at once."""
    model = Trees()
    if not len(y):
        return model
    share = (y.sum() + 1) / (len(y) + 2)
    model.start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    count = x.shape[1]
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(count)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cells = binned + np.arange(count) * BINS
    margin, inner = np.full(len(y), model.start), 2 ** model.depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(model.depth):
            first, width = 2 ** level - 1, 2 ** level
            flat = ((node - first)[:, None] * (count * BINS) + cells).ravel()

            def gathered(v, flat=flat, width=width):
                return np.bincount(flat, np.repeat(v, count), width * count * BINS).reshape(width, count, BINS).cumsum(2)

            gl, hl, nl = gathered(g), gathered(h), gathered(np.ones(len(y)))
            gt, ht, nt = gl[..., -1:], hl[..., -1:], nl[..., -1:]
            gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
            gain[(nl < LEAST) | (nt - nl < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i in range(width):
                f, b = divmod(int(best[i]), BINS)
                if gain[i, f, b] > 1e-6 and b < len(edges[f]):
                    feature[first + i], threshold[first + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -RATE * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + L2)
        margin += value[leaf]
        model.feature = np.vstack([model.feature, feature])
        model.threshold = np.vstack([model.threshold, threshold])
        model.value = np.vstack([model.value, value])
    return model


def held_out(doc_id):
    """Whether the CRC-32 of the id's text leaves no rest by 5; such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """``rows``: doc_id, x. ``labels``: doc_id, quality."""
    known = labels.where("doc_id is not null and quality is not null and not isnan(quality)").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    some = thinned(settle(rows.join(known, "doc_id")), F.col("doc_id"), sample).orderBy(order, "doc_id", "x").limit(sample).toPandas()
    x = np.array(some["x"].tolist(), float) if len(some) else np.zeros((0, 1))
    return fit(x, some["y"].to_numpy(float))


def score(rows: DataFrame, model: Trees) -> DataFrame:
    """doc_id, score of every row of features."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.stack(batch["x"].to_list())
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": model.score(x)})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = settle(features(docs))
    scored = score(rows, train(rows, labels, sample))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` whose texts score ``THRESHOLD`` or more."""
    model = train(settle(features(docs)), labels, sample)

    @F.pandas_udf("double")
    def quality(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t or "") for t in texts])))

    return small_batches(docs).where(quality("text") >= THRESHOLD)


shipped(__name__)
