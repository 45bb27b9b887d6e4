"""Substring dedup: word windows found again in later documents go, by level-wise doubling.

Windows of a short length are looked up first. Only windows that stand in two documents or more at one length are
extended to (at most) twice that length, and so on up to the asked length; with no candidate left the work is over. A
window of ``2n`` words is known by the hashes of its first and its last ``n`` words, so a level's hashes come from those
of the level before. Of the windows of a short level only the smallest hash among those in each window of the next
level is looked up: a longer window that is repeated holds it at the same offset in all its copies.

A level's repeated hashes reach the next scan as a bitmap with 16 bits for each of them, 128 MB at most, after
which it lets more through. A false hit costs rows and changes nothing: at the last level all candidates are compared by
a shuffle on their hash, in which a window of very many documents is reduced before it moves, and again in a join
that Spark can split. Texts without a candidate never move; the others move once.

A word is removed if a window of ``words`` words that covers it also starts in a document with a smaller id. Windows are
judged on the input, so what is removed elsewhere makes no difference.

Nulls and edges: words are what stands between ASCII white space; a null or empty text has none. A null id is neither
smaller nor larger than another: such documents lose nothing and take nothing away. Rows that repeat an id are
documents of equal rank: none of them loses words to the other, all lose those of smaller ids. Windows are
known by 64-bit hashes. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import scratch, shipped, small_batches, word_hashes
from prosa.llm.jaccard import mixed

WORDS = 13
#: Lengths are halved until they are this short.
SEED = 8
#: Bits of a level's map for each repeated window, and the logarithms of its smallest and largest size and of a piece.
BITS, SMALLEST, LARGEST, PIECE = 16, 20, 30, 22
#: Bytes of text that a task handles at a time (one document at least).
CHUNK = 2_000_000
STEP = np.uint64(0x9E3779B97F4A7C15)


def lengths(words: int) -> list[int]:
    """The lengths of the levels; each is at most twice the one before."""
    out = [words]
    while out[0] > SEED:
        out.insert(0, (out[0] + 1) // 2)
    return out


def sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[:n - width], x[width - n:]) if n < width else x


def extended(h: np.ndarray, size: int, to: int) -> np.ndarray:
    """Hashes of windows of ``to`` words from those of windows of ``size``."""
    while size < to:
        more = min(2 * size, to)
        n = max(len(h) - (more - size), 0)
        h = mixed(h[:n] * STEP + h[more - size:more - size + n])
        size = more
    return h


def in_map(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    place = h & np.uint64(8 * len(bits) - 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def windows(h: np.ndarray, doc: np.ndarray, steps: list[int], maps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of the level after those of ``maps``, and which are candidates: those in one document
    that hold no window found in a single document at a level before. ``h``: word hashes, ``doc``: each word's document."""
    size = 1
    alive = np.ones(len(h), bool)
    for k, step in enumerate(steps[:len(maps) + 1]):
        if len(doc) < step:
            return h[:0], alive[:0]
        before, was = h, size
        h, size = extended(h, size, step), step
        inside = doc[:len(h)] == doc[step - 1:]
        if k:
            width = step - was + 1
            alive = ~sliding(np.maximum, ~alive, width) & in_map(maps[k - 1], sliding(np.minimum, before, width)) & inside
        else:
            alive = inside
    return h, alive


def chunks(texts: pd.Series) -> Iterator[tuple[list[int], list[bytes], np.ndarray, np.ndarray]]:
    """Some documents at a time: their places in ``texts``, their texts, all word hashes in a row, each word's document."""
    rows, held, n = [], [], 0

    def together() -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
        h, start = word_hashes(b"\n".join(held))
        first = np.cumsum([0, *[len(x) + 1 for x in held[:-1]]])
        return rows, held, h, np.searchsorted(first, start, side="right") - 1

    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "replace")
        if n and n + len(data) > CHUNK:
            yield together()
            rows, held, n = [], [], 0
        rows.append(i)
        held.append(data)
        n += len(data)
    if held:
        yield together()


def looked_up(docs: DataFrame, steps: list[int], maps: list) -> DataFrame:
    """h, doc_id: what a level before the last looks up, for each document."""
    rows = small_batches(docs.where("doc_id is not null").select("doc_id", "text"))
    k = len(maps)
    width = steps[k + 1] - steps[k] + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [m.value for m in maps]
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for at, _, h, doc in chunks(batch["text"]):
                h, alive = windows(h, doc, steps, known)
                if len(h) < width:
                    continue
                low, ok = sliding(np.minimum, h, width), ~sliding(np.maximum, ~alive, width)
                mine = doc[:len(low)]
                ok[1:] &= ~(ok[:-1] & (low[1:] == low[:-1]) & (mine[1:] == mine[:-1]))
                yield pd.DataFrame({"h": low[ok].view(np.int64), "doc_id": ids[np.array(at)[mine[ok]]]})

    return rows.mapInPandas(run, f"h long, doc_id {rows.schema['doc_id'].dataType.simpleString()}")


def repeated(rows: DataFrame, *columns: str) -> DataFrame:
    """The hashes that stand in several documents, with the smallest id; written and read again."""
    folder = scratch(rows.sparkSession, "windows")
    both = rows.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    both.select("h", *columns).write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def bitmap(hashes: DataFrame) -> np.ndarray | None:
    """One bit for each hash, in pieces made by Spark; None without hashes."""
    n = hashes.count()
    if not n:
        return None
    size = min(max((BITS * n - 1).bit_length(), SMALLEST), LARGEST)
    place = F.pmod("h", F.lit(1 << size))
    at = hashes.select(F.shiftright(place, PIECE).alias("piece"), F.pmod(place, F.lit(1 << PIECE)).alias("bit"))

    def piece(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(min(1 << PIECE, 1 << size), np.uint8)
        bits[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((1 << size) // 8, np.uint8)
    step = (1 << PIECE) // 8
    for row in at.distinct().groupBy("piece").applyInPandas(piece, "piece long, bits binary").toLocalIterator():
        out[row["piece"] * step:row["piece"] * step + len(row["bits"])] = np.frombuffer(row["bits"], np.uint8)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))


def candidates(docs: DataFrame, steps: list[int], maps: list) -> DataFrame:
    """h, doc_id, key: the candidate windows of the last level, once for each document."""
    rows = small_batches(keyed(docs).where("doc_id is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [m.value for m in maps]
        for batch in batches:
            ids, keys = batch["doc_id"].to_numpy(), batch["key"].to_numpy()
            for at, _, h, doc in chunks(batch["text"]):
                h, alive = windows(h, doc, steps, known)
                h, mine = h[alive], doc[:len(alive)][alive]
                order = np.lexsort((h, mine))
                h, mine = h[order], mine[order]
                once = np.ones(len(h), bool)
                once[1:] = (h[1:] != h[:-1]) | (mine[1:] != mine[:-1])
                place = np.array(at)[mine[once]]
                yield pd.DataFrame({"h": h[once].view(np.int64), "doc_id": ids[place], "key": keys[place]})

    return rows.mapInPandas(run, f"h long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, key long")


def without(words: list[bytes], gone: np.ndarray) -> tuple[str, int, list[dict[str, int]]]:
    """The words that stay, how many go, and where: runs of words, end exclusive."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    kept = words if not len(edge) else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return b" ".join(kept).decode("utf-8", "replace"), len(words) - len(kept), spans


OUT = "kept string, n_words long, n_removed long, removed array<struct<start:int,end:int>>"


def untouched(docs: DataFrame, steps: list[int], maps: list | None) -> DataFrame:
    """The documents without a candidate, finished. ``maps`` is None if no window at all is repeated."""
    rows = small_batches(docs.select("doc_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [m.value for m in maps or []]
        for batch in batches:
            out, places, ids = [], [], batch["doc_id"]
            for at, held, h, doc in chunks(batch["text"]):
                open_ = set()
                if maps is not None:
                    _, alive = windows(h, doc, steps, known)
                    open_ = set(np.unique(doc[:len(alive)][alive]).tolist())
                for k, (i, w) in enumerate(zip(at, held, strict=True)):
                    if k not in open_ or pd.isna(ids.iloc[i]):
                        places.append(i)
                        tokens = w.split()
                        out.append((b" ".join(tokens).decode("utf-8", "replace"), 0, [], len(tokens)))
            frame = pd.DataFrame(out, columns=["kept", "n_removed", "removed", "n_words"])
            frame.insert(0, "doc_id", ids.iloc[places].to_numpy())
            yield frame[["doc_id", "kept", "n_words", "n_removed", "removed"]]

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}")


def touched(docs: DataFrame, steps: list[int], maps: list) -> DataFrame:
    """doc_id, text, key of the documents with a candidate."""
    rows = small_batches(keyed(docs).where("doc_id is not null"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [m.value for m in maps]
        for batch in batches:
            for at, _, h, doc in chunks(batch["text"]):
                _, alive = windows(h, doc, steps, known)
                yield batch.iloc[np.array(at)[np.unique(doc[:len(alive)][alive])]]

    return rows.mapInPandas(run, rows.schema)


def cut(rows: DataFrame, steps: list[int]) -> DataFrame:
    """The documents of :func:`touched` without the words of the windows in ``again``."""
    words = steps[-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, again in zip(batch["text"], batch["again"], strict=True):
                data = (text or "").encode("utf-8", "replace")
                tokens = data.split()
                gone = np.zeros(len(tokens) + 1, np.int64)
                if again is not None and len(tokens) >= words:
                    h, size = word_hashes(data)[0], 1
                    for step in steps:
                        h, size = extended(h, size, step), step
                    start = np.flatnonzero(np.isin(h.view(np.int64), np.asarray(again, np.int64)))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + words, -1)
                out.append(without(tokens, np.cumsum(gone)[:-1] > 0) + (len(tokens),))
            frame = pd.DataFrame(out, columns=["kept", "n_removed", "removed", "n_words"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame[["doc_id", "kept", "n_words", "n_removed", "removed"]]

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}")


def substring_dedup(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, kept (words that stay, joined by one space), n_words, n_removed and removed (runs of words) of every document."""
    steps, maps = lengths(words), []
    sc = docs.sparkSession.sparkContext
    for _ in steps[1:]:
        bits = bitmap(repeated(looked_up(docs, steps, maps)))
        if bits is None:  # no candidate survives
            return untouched(docs, steps, None)
        maps.append(sc.broadcast(bits))
    found = candidates(docs, steps, maps)
    first = repeated(found, "first")
    again = found.join(first, "h").where("doc_id > first").groupBy("key").agg(F.collect_set("h").alias("again"))
    later = touched(docs, steps, maps).join(again, "key", "left").select("doc_id", "text", "again")
    return untouched(docs, steps, maps).unionByName(cut(small_batches(later), steps))


shipped(__name__)
