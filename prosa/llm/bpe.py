"""Byte-level BPE encoding and decoding by walks over a trie of distinct words.

The distinct words of a block of texts are put in order, which is a depth-first walk over their trie: what a
word shares with the one before is kept on a stack and not worked out again. The state of a prefix is the
last token of its encoding. Of all tokens that end at a place exactly one follows: the one whose rest
of the prefix has a last token it can stand next to, that is, the merges leave the two as they are.

The vocabulary comes from a file named by the caller and reaches executors as one broadcast of the
file's size. A worker remembers the words and units it has encoded, in two generations: when the younger one holds
``REMEMBER`` of them, it becomes the older one, and what was not used since the last time is forgotten. So what comes
again and again stays; that bounds memory and changes no result. Their ids are kept as packed integers. Null texts count as empty and have no tokens; long texts are
handled whole; repeated rows get a row each; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import json
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from prosa.llm.common import give_back, shipped, small_batches

REMEMBER = 250_000
BLOCK = 500_000
#: After so many blocks, and at the end of a task, a worker returns the memory it has freed.
RETURN = 4
#: White space as Unicode defines it, and the words of byte-level BPE: fixed values.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORDS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|[" + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + "]+")


def byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files, from the rule that defines it."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Coder:
    """Encodes and decodes with one vocabulary."""

    def __init__(self, definition: str):
        data = json.loads(definition)
        names = byte_names()
        model = data.pop("model")

        def as_bytes(name: str) -> bytes:
            return bytes(names[c] for c in name)

        self.ids = {as_bytes(t): i for t, i in model["vocab"].items() if all(c in names for c in t)}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        for t in self.special:
            if self.ids.get(t.encode()) == self.special[t]:
                del self.ids[t.encode()]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        self.known, self.older, self.pairs, self.spines = {}, {}, defaultdict(dict), {}
        self.sizes = {i: len(b) for i, b in self.bytes.items()}
        self.endings = None
        self.words = regex.compile(WORDS)
        self.across = regex.compile(f" [{SPACE}]|[{SPACE}] ")
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def edges(self, token: int) -> tuple[list[tuple[int, float]], list[tuple[int, float]]] | None:
        """The parts at the right and at the left edge while the token's bytes are merged, each with the rank
        of the merge that takes it up; None if merging its bytes doesn't give the token."""
        if token not in self.spines:
            parts = [self.ids[bytes((b,))] for b in self.bytes[token]]
            right, left = [], []
            while len(parts) > 1:
                found = [(self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
                if not found:
                    break
                rank, i = min(found)
                if i + 2 == len(parts):
                    right.append((parts[i + 1], rank))
                if i == 0:
                    left.append((parts[0], rank))
                parts[i:i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
            last = (token, float("inf"))
            self.spines[token] = ([*right, last], [*left, last]) if parts == [token] else None
        return self.spines[token]

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` stays apart when it follows ``last``; -1 for the start of a word.

        It doesn't if parts at their common edge merge before either is taken up on its own side; of
        two merges of one rank the left one comes first.
        """
        own = self.edges(token)
        if last < 0 or own is None:
            return own is not None
        for r, taken in self.edges(last)[0]:
            for left, also in own[1]:
                merge = self.merges.get((r, left))
                if merge and merge[0] < taken and merge[0] <= also:
                    return False
        return True

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Token ids of each distinct word, packed, from one walk over the trie of the words.

        A word is given as its UTF-8 bytes, one character each, which for ASCII is the word itself.
        """
        if self.endings is None:
            self.endings = ahocorasick.Automaton()
            for token, i in self.ids.items():
                self.endings.add_word(token.decode("latin-1"), (i, len(token)))
            self.endings.make_automaton()
        out, path, states, after = {}, "", [-1], [self.pairs[-1]]
        pairs, endings, sizes = self.pairs, self.endings, self.sizes
        for word in sorted(set(words)):
            same, most = 0, min(len(path), len(word))
            while same < most and path[same] == word[same]:
                same += 1
            del states[same + 1:], after[same + 1:]
            reached = same
            for last, (token, size) in endings.iter(word):
                if last < reached:
                    continue
                start = last + 1 - size
                fits = after[start].get(token)
                if fits is None:
                    fits = after[start][token] = self.follows(states[start], token)
                if fits:
                    states.append(token)
                    after.append(pairs[token])
                    reached = last + 1
            path, end, tokens = word, len(word), []
            while end > 0:
                token = states[end]
                tokens.append(token)
                end -= sizes[token]
            tokens.reverse()
            out[word] = array("i", tokens).tobytes()
        return out

    def units(self, text: str) -> list[str]:
        """The text cut into parts whose words don't depend on what is around them."""
        out, at = [], 0
        for mark in [*self.marks.finditer(text), None] if self.marks else [None]:
            piece = text[at:mark.start()] if mark else text[at:]
            if self.across.search(piece):
                out += self.words.findall(piece)
            elif piece:
                first, *rest = piece.split(" ")
                if first:
                    out.append(first)
                out += [" " + r for r in rest]
            if mark:
                out.append("\0" + mark[0])
                at = mark.end()
        return out

    def learn(self, units: set[str]) -> None:
        """After this all ``units`` are known."""
        if len(self.known) > REMEMBER:
            self.older, self.known = self.known, {}
            if sum(map(len, self.pairs.values())) > REMEMBER:
                self.pairs.clear()
        known, older = self.known, self.older.get
        single, several, fresh = [], {}, {}
        for u in units.difference(known):
            if (ids := older(u)) is not None:
                known[u] = ids
            elif u[0] == "\0" and u[1:] in self.special:
                known[u] = array("i", (self.special[u[1:]],)).tobytes()
            elif u[1:].isalpha() and (u[0] == " " or u[0].isalpha()):
                single.append(u)
            else:
                several[u] = self.words.findall(u)
        for w in set(chain(single, *several.values())).difference(known):
            if (ids := older(w)) is not None:
                known[w] = ids
            else:
                fresh[w] = w if w.isascii() else w.encode().decode("latin-1")
        ids = self.encode_words(fresh.values())
        for w, data in fresh.items():
            known[w] = ids[data]
        for u, ws in several.items():
            if len(ws) > 1:
                known[u] = b"".join(map(known.__getitem__, ws))

    def encode(self, texts: list[str]) -> list[array]:
        cut = [self.units(t) for t in texts]
        self.learn(set().union(*cut))
        known = self.known.__getitem__
        return [array("i", b"".join(map(known, units))) for units in cut]

    def batches(self, batches: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.Series, list[array]]]:
        """The doc_ids and tokens of each block of texts."""
        done = 0
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            for a, b in blocks(texts):
                yield batch["doc_id"].iloc[a:b], self.encode(texts[a:b])
                done += 1
                if done % RETURN == 0:
                    give_back()
        # Batches end with the task. The worker waits for another with what it remembers, not with what it has freed.
        batch = texts = None
        give_back()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def shared_file(spark, path: str):
    """The vocabulary file, broadcast: a few MB. A worker keeps the coder it makes of it beside it."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"definition": f.read()})


def coder_in(holder: dict) -> Coder:
    if "coder" not in holder:
        holder["coder"] = Coder(holder["definition"])
    return holder["coder"]


def blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``BLOCK`` characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if texts:
        yield start, len(texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the tokens of every document."""
    rows = small_batches(docs.select("doc_id", "text"))
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_in(shared.value)
        for ids, coded in coder.batches(batches):
            yield pd.DataFrame({"doc_id": ids, "ids": [np.frombuffer(c, np.int32) for c in coded]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The columns of ``encoded`` (``ids`` among them) and ``decoded``: the text of the tokens. Null ids: empty."""
    shared = shared_file(encoded.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_in(shared.value)
        for batch in batches:
            batch["decoded"] = [coder.decode(i.tolist()) if i is not None else "" for i in batch["ids"]]
            yield batch

    return encoded.mapInPandas(run, schema + ", decoded string")


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded: tokens of every document and the text they give back, in one pass."""
    rows = small_batches(docs.select("doc_id", "text"))
    shared = shared_file(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = coder_in(shared.value)
        for ids, coded in coder.batches(batches):
            yield pd.DataFrame({"doc_id": ids, "ids": [np.frombuffer(c, np.int32) for c in coded], "decoded": [coder.decode(c) for c in coded]})

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


shipped(__name__)
