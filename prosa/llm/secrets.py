"""Secret scan: Aho-Corasick over keywords, anchored patterns only at its hits, checksums at the end.

Base kinds: ``assign`` (a keyword, a sign, a value of 6 characters or more), ``access`` (``AKIA`` and 16 or more
of A-Z0-9) and ``hex`` (a run of 24 or more of 0-9a-f). A run of hex digits that long holds a digit or four letters
a-f in a row, so those are its keywords. Added kinds, ``github`` and ``npm``: a public prefix and 36 characters, the last
six of which are the CRC-32 of the 30 before them in base 62; a token with another checksum is none.

A scan touches a text's characters once and patterns only at hits. Null texts count as empty and have no spans;
repeated rows get a row each; extra columns are ignored; empty tables give no rows. Each row is
independent, so there is no shuffle and a lost task is simply run again.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from prosa.llm.common import LOWER, UPPER, shipped, small_batches

KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
CHECKED = re.compile("(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
TO_LOWER = str.maketrans(UPPER, LOWER)


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        a.add_word(word, ("assign", len(word)))
    a.add_word("akia", ("access", 4))
    for word in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"):
        a.add_word(word, ("checked", 4))
    for word in itertools.chain("0123456789", map("".join, itertools.product("abcdef", repeat=4))):
        a.add_word(word, ("hex", len(word)))
    a.make_automaton()
    return a


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out


def find(text: str, keywords: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(TO_LOWER)
    done = dict.fromkeys(("assign", "access", "hex", "checked"), 0)
    spans = []
    for end, (kind, length) in keywords.iter(low):
        start = end - length + 1
        if kind == "hex":
            if end < done["hex"] or not HEX.match(text, end):
                continue
            start = end
            while start > 0 and text[start - 1] in "0123456789abcdef":
                start -= 1
            stop = HEX.match(text, start).end()
            done["hex"] = stop
            if stop - start >= MIN_HEX:
                spans.append((kind, start, stop))
        elif start >= done[kind]:
            m = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED}[kind].match(text, start)
            if not m:
                continue
            done[kind] = m.end()
            if kind == "checked":
                if base62_crc(m[1]) == m[2]:
                    spans.append(("npm" if m[0].startswith("npm") else "github", start, m.end()))
            elif len(m[2]) >= MIN_VALUE if kind == "assign" else m.end() - start >= MIN_ACCESS:
                spans.append((kind, start, m.end()))
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_checked, base_sha256, spans of every document."""
    rows = small_batches(docs.select("doc_id", "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keywords = automaton()
        for batch in batches:
            found = [find(t or "", keywords) for t in batch["text"]]
            base = [[s for s in spans if s[0] in KINDS[:3]] for spans in found]
            counts = {f"n_{k}": [sum(s[0] == k for s in spans) for spans in base] for k in KINDS[:3]}
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], **counts, "n_checked": [len(a) - len(b) for a, b in zip(found, base, strict=True)],
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base], "spans": [joined(s) for s in found]})

    return rows.mapInPandas(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string")


shipped(__name__)
