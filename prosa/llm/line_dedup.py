"""Line dedup: later copies of repeated passages go, found word by word by windows with common anchors.

A passage is a run of ``MIN_WORDS`` words or more, wherever it begins and ends: lines are not what is compared. A word
goes if it lies in a run of so many words that stands, word for word, at an earlier place (smaller document id, then
earlier word); the earliest copy stays. Lines that lose all words go whole, others lose the piece.

Every run of ``MIN_WORDS`` words is a window with a rolling hash. A window's anchor is the smallest hash of the half as long
runs in it, so equal windows have equal anchors, and neighbouring windows mostly share theirs; the words of the windows
around one anchor are its block. A first pass writes a row for each anchor, about one in thirteen words, with a hash of
its block. Anchors that stand once can't be in a copy. Where all blocks of an anchor are equal, their windows have the same
copies, so the second pass writes the block as one; where blocks differ, at the edges of passages, it writes each window.
Bitmaps of a fixed size tell which anchor is which; a false hit costs rows and changes nothing. What has an earlier copy
gives all words of all maximal runs. Blocks and windows are known by 96-bit hashes and move once. Texts move once, in the
last join, and only those of documents that a bitmap of a fixed size says may lose words.

Two exceptions: a single word at the edge of a passage stays if its line has other words left, as chance gives that much;
and a run that overlaps its earlier place, both beginning in one line, is no copy (a word or phrase said over and over).

Nulls and edges: words are what stands between ASCII white space; lines without words stay; a null text stays
null; a null id is later than all others. Rows that repeat both id and text count as one document and get the same
result. ``n_deleted`` counts lines that lost words. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prosa.llm.common import PIECE, settle, shipped, small_batches, word_hashes

MIN_WORDS = 50
#: Bits of each map of anchors that stand more than once.
FILTER = 1 << 26
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Powers:
    """The powers of a base and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.steps = [np.uint64(base), np.uint64(pow(base, -1, 1 << 64))]
        self.held = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def up_to(self, n: int) -> list[np.ndarray]:
        if len(self.held[0]) < n:
            exponents = np.arange(2 * n, dtype=np.uint64)
            self.held = [np.power(x, exponents) for x in self.steps]
        return self.held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sums(h: np.ndarray, powers: Powers) -> np.ndarray:
    """Prefix sums of a polynomial in the base; ``h``: hashes of the words."""
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers.up_to(len(h) + 1)[0][:len(h)], dtype=np.uint64)])


def hash_of(total: np.ndarray, powers: Powers, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """Hashes of the runs of ``size`` words from ``start`` on."""
    return mixed((total[start + size] - total[start]) * powers.up_to(len(total))[1][start] + np.asarray(size, np.uint64))


def sliding(f: Callable, x: np.ndarray, width: int) -> np.ndarray:
    """``f`` (minimum or maximum) over each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        x, n = f(x[:-n], x[n:]), 2 * n
    return f(x[:n - width], x[width - n:]) if n < width else x


def anchors_of(total: np.ndarray, least: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """The anchors along a document, first and last window of each, and whether one of them stands for several places."""
    half = (least + 1) // 2
    width = least - half + 1
    short = hash_of(total, powers, np.arange(len(total) - half), half)
    anchor = sliding(np.minimum, short, width)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    last = np.append(first[1:], len(anchor)) - 1
    edge = np.zeros(width - 1, np.uint64)
    places = np.count_nonzero(short == sliding(np.maximum, np.concatenate([edge, anchor, edge]), width))
    return anchor[first], first, last, places != len(first)


def hashed(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
    """Of each text the hashes of its words, where they start, and its bytes. Short texts are hashed together."""
    held, size = [], 0

    def together() -> Iterator[tuple[np.ndarray, np.ndarray, bytes]]:
        h, start = word_hashes(b"\n".join(held))
        at = np.cumsum([0, *[len(x) + 1 for x in held]])
        cut = np.searchsorted(start, at)
        for i, data in enumerate(held):
            yield h[cut[i]:cut[i + 1]], start[cut[i]:cut[i + 1]] - at[i], data

    for text in texts:
        held.append((text or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size > PIECE:
            yield from together()
            held, size = [], 0
    yield from together()


def bit_of(column: str) -> tuple[Column, Column]:
    """A hash's place in a bitmap, and its bit within a cell of 64."""
    bit = F.col(column).bitwiseAND(F.lit(FILTER - 1))
    return bit, F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int"))


def repeated_anchors(docs: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bitmaps of the anchors that stand more than once: in equal blocks, one a document; and others."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers(BASES[0])
        for batch in batches:
            anchors, blocks = [], []
            for h, _, _ in hashed(batch["text"]):
                if len(h) < least:
                    continue
                total = sums(h, powers)
                anchor, first, last, several = anchors_of(total, least, powers)
                block = hash_of(total, powers, first, last - first + least)
                order = np.argsort(anchor)
                same = np.diff(anchor[order]) == 0
                if several:  # as if each had two blocks
                    anchor, block = np.concatenate([anchor, anchor]), np.concatenate([block, block ^ np.uint64(1)])
                elif same.any():  # as if all blocks of one anchor differed
                    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
                    block[again] ^= mixed(first[again].astype(np.uint64) + np.uint64(BASES[1]))
                anchors.append(anchor)
                blocks.append(block)
            if anchors:
                yield pd.DataFrame({"anchor": np.concatenate(anchors).view(np.int64), "block": np.concatenate(blocks).view(np.int64)})

    rows = small_batches(docs.select("text")).mapInPandas(run, "anchor long, block long")
    known = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("block").alias("x"), F.max("block").alias("y")).where("n > 1")
    bit, one = bit_of("anchor")
    zero = F.lit(0).cast("long")
    cells = known.groupBy(F.shiftright(bit, 6).alias("cell")).agg(
        F.bit_or(F.when(F.col("x") == F.col("y"), one).otherwise(zero)).alias("equal"),
        F.bit_or(F.when(F.col("x") != F.col("y"), one).otherwise(zero)).alias("other")).toPandas()
    return filled(cells, "equal"), filled(cells, "other")


def filled(cells: pd.DataFrame, name: str) -> np.ndarray:
    bits = np.zeros(FILTER // 64, np.uint64)
    bits[cells["cell"].to_numpy(np.int64)] = cells[name].to_numpy(np.int64).view(np.uint64)
    return bits


def in_map(bits: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    place = anchor & np.uint64(FILTER - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def close_repeats(h: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """Which windows overlap an equal one of the same document."""
    order = np.lexsort((at, h))
    near = (np.diff(h[order]) == 0) & (np.diff(at[order]) < least)
    out = np.zeros(len(h), bool)
    out[order[1:]] |= near
    out[order[:-1]] |= near
    return out


def window_rows(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, th, pos, size, line, loops, h1, h2: the blocks and windows that may stand more than once."""
    shared = docs.sparkSession.sparkContext.broadcast(repeated_anchors(docs, least))
    rows = small_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("th")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers, others = Powers(BASES[0]), Powers(BASES[1])
        equal, other = shared.value

        def of_document(h: np.ndarray, start: np.ndarray, data: bytes) -> tuple[np.ndarray, ...] | None:
            if len(h) < least:
                return None
            total = sums(h, powers)
            anchor, first, last, _ = anchors_of(total, least, powers)
            single = in_map(other, anchor)
            whole = in_map(equal, anchor) & ~single
            if not (single.any() or whole.any()):
                return None
            windows = np.flatnonzero(np.repeat(single, last - first + 1))
            at = np.concatenate([first[whole], windows])
            size = np.concatenate([(last - first)[whole] + least, np.full(len(windows), least)])
            one = hash_of(total, powers, at, size)
            two = hash_of(sums(mixed(h ^ np.uint64(BASES[1])), others), others, at, size) >> np.uint64(33)
            line = np.searchsorted(np.flatnonzero(np.frombuffer(data, np.uint8) == 10), start[at])
            loops = np.zeros(len(at), bool)
            loops[len(at) - len(windows):] = close_repeats(one[len(at) - len(windows):], windows, least)
            return at, size, line, loops, one.view(np.int64), two.astype(np.int64)

        def table(batch: pd.DataFrame, found: list[tuple[int, tuple[np.ndarray, ...]]]) -> pd.DataFrame:
            rows = np.repeat([i for i, _ in found], [len(f[0]) for _, f in found])
            values = [np.concatenate(x) for x in zip(*(f for _, f in found), strict=True)]
            places = {c: batch[c].iloc[rows].to_numpy() for c in ("doc_id", "th")}
            return pd.DataFrame(places | dict(zip(("pos", "size", "line", "loops", "h1", "h2"), values, strict=True)))

        for batch in batches:
            found, held = [], 0
            for i, words in enumerate(hashed(batch["text"])):
                if (f := of_document(*words)) is not None:
                    found.append((i, f))
                    held += len(f[0])
                    if held > 200_000:
                        yield table(batch, found)
                        found, held = [], 0
            if found:
                yield table(batch, found)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, th long, pos int, size int, line int, loops boolean, h1 long, h2 int")


def later_copies(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, cuts: of each document with later copies, the runs of words to delete, as 2^32 * pos + size; stored."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "pos", "line", "size", "loops")
    windows = window_rows(docs, least).select("h1", "h2", place.alias("place"))
    first = F.min("place").over(Window.partitionBy("h1", "h2"))
    apart = "not place.loops or not (place.doc_id <=> first.doc_id) or place.th <> first.th or place.line <> first.line"
    copies = windows.withColumn("first", first).where("place > first").where(apart)
    run = F.col("place.pos").cast("long") * F.lit(1 << 32) + F.col("place.size")
    return settle(copies.groupBy("place.doc_id", "place.th").agg(F.collect_set(run).alias("cuts")))


def without_words(line: str, gone: np.ndarray) -> str:
    """The line without the words in ``gone`` and the white space that set them apart."""
    spans = [m.span() for m in WORD.finditer(line)]
    kept = np.flatnonzero(~gone)
    out, at = [], 0
    for k in np.flatnonzero(gone[:-1] & ~gone[1:]):  # the last of a piece that words follow
        before = kept[kept < k]
        out.append(line[at:spans[before[-1] + 1 if len(before) else 0][0]])
        at = spans[k + 1][0]
    if gone[-1]:
        return "".join([*out, line[at:spans[kept[-1]][1]], line[spans[-1][1]:]])
    return "".join([*out, line[at:]])


def line_words(text: str | None) -> tuple[list[str], list[int], int, int]:
    """The lines and their numbers of words; how many lines have words, and how many words there are."""
    rows = (text or "").split("\n")
    counts = [len(x.encode("utf-8", "replace").split()) for x in rows]
    return rows, counts, sum(c > 0 for c in counts), sum(counts)


def without(texts: pd.Series, cuts: pd.Series) -> pd.DataFrame:
    """The text without the runs of words, and what was there before and after."""
    out = []
    for text, runs in zip(texts, cuts, strict=True):
        rows, counts, n, total = line_words(text)
        if runs is None or not len(runs):
            out.append((text, n, 0, total, total))
            continue
        runs = np.asarray(runs, np.int64)
        starts, sizes = runs >> 32, runs & 0xFFFFFFFF
        steps = np.zeros(total + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + sizes, -1)
        gone = np.cumsum(steps)[:total] > 0
        kept, left, hit, at = [], 0, 0, 0
        for row, c in zip(rows, counts, strict=True):
            mine = gone[at:at + c].copy()
            at += c
            if c > 1 and not mine.all():
                mine[:1] &= mine[1:2]  # a single word at an edge stays
                mine[-1:] &= mine[-2:-1]
            hit += bool(mine.any())
            left += int((~mine).sum())
            if not mine.any():
                kept.append(row)
            elif not mine.all():
                kept.append(without_words(row, mine))
        out.append(("\n".join(kept), n, hit, total, left) if hit else (text, n, 0, total, total))
    return pd.DataFrame(out, columns=["text", "n_lines", "n_deleted", "n_words", "n_words_left"])


def line_dedup(docs: DataFrame, least: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, n_lines, n_deleted, n_words, n_words_left of every document, and the columns in ``keep``."""
    cuts = later_copies(docs, least)
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "th")
    bit, one = bit_of("_key")
    cells = cuts.select(key.alias("_key")).groupBy(F.shiftright(bit, 6).alias("cell")).agg(F.bit_or(one).alias("bits")).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(filled(cells, "bits"))

    def lose(k: pd.Series) -> np.ndarray:
        return in_map(shared.value, k.to_numpy(np.int64).view(np.uint64))

    def look(k: pd.Series, texts: pd.Series) -> pd.DataFrame:
        may = lose(k)
        counts = [(0, 0) if m else line_words(t)[2:] for m, t in zip(may, texts, strict=True)]
        return pd.DataFrame(counts, columns=["n_lines", "n_words"]).assign(may=may)

    may_lose = F.pandas_udf(lambda k: pd.Series(lose(k)), "boolean")
    # One Python step for each stage: every further one is one more Python process for each core. So texts that lose nothing
    # are counted where that is seen (as nondeterministic, else the filter would run it again), and the others are shuffled.
    looked = F.pandas_udf(look, "struct<n_lines int, n_words int, may boolean>").asNondeterministic()
    cut = F.pandas_udf(without, "struct<text string, n_lines int, n_deleted int, n_words int, n_words_left int>")
    rows = docs.select(*[F.col(c).alias(f"_{c}") for c in keep], "doc_id", "text", F.xxhash64("text").alias("th"))
    held = [f"_{c}" for c in keep]
    c = cuts.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "cuts")
    moved = rows.where(may_lose(key)).join(
        c.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    moved = moved.select("doc_id", *held, cut("text", "cuts").alias("_out")).select("doc_id", *held, "_out.*")
    rest = rows.select("*", looked(key, "text").alias("_seen")).where("not _seen.may").select(
        "doc_id", *held, "text", "_seen.n_lines", F.lit(0).alias("n_deleted"), "_seen.n_words", F.col("_seen.n_words").alias("n_words_left"))
    out = rest.unionByName(moved)
    return out.select("doc_id", *[F.col(f"_{c}").alias(c) for c in keep], "text", "n_lines", "n_deleted", "n_words", "n_words_left")


shipped(__name__)
