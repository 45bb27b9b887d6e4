"""Personal data: patterns with checks, and a character-level bidirectional LSTM with a CRF on top.

The network is trained in numpy on the driver from windows whose characters carry the labels of spans; the number
of windows is a bounded sample (``SAMPLE``, chosen by hashes). It decodes overlapping windows
of ``WIDTH`` characters, ``WIDTH / 2`` apart, over whole texts. A character takes its label from the window
in whose middle half it lies (the first and last window also give the text's ends), and spans
are read off the labels of the whole text, so a span may cross windows.

Each kind needs a digit or an ``@``. A window without either can hold no span and is labelled ``O`` without being
decoded; that changes no result. Spans of the network are added if they touch no span of the patterns and hold
what the kind demands (digits, Luhn sum, parts up to 255, an ``@``).

Null texts count as empty and have no spans; repeated rows get a row each; extra columns are ignored; empty
tables give no rows, and a corpus without spans trains nothing and adds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import shipped, small_batches, thinned

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What a span of the network may consist of, and what may stand beside it.
ALLOWED = {"email": re.compile(r"[^\s@]+@[^\s@]+"), "ip": re.compile(r"[0-9]+(?:[. :-]+[0-9]+){3}"),
           "card": re.compile(r"[0-9][0-9 .-]+[0-9]"), "phone": re.compile(r"\(?[+0-9][0-9 ().-]+[0-9]")}
MARKS = " .,;:()<>"
EVIDENCE = re.compile("[0-9@]")
DIGITS = re.compile("[0-9]")
WIDTH = 96
STEP = WIDTH // 2
SAMPLE, EPOCHS, HIDDEN, INPUT, BATCH, RATE = 1200, 8, 16, 12, 48, 0.01
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
CODES = 130  # ASCII, any other character, none


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind: str, value: str) -> bool:
    """What a span of the kind must hold, whoever found it."""
    digits = "".join(DIGITS.findall(value))
    if kind == "email":
        name, _, host = value.partition("@")
        return bool(name) and "." in host.strip(".")
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        for m in PATTERNS[kind].finditer(text):
            if kind == "email" or holds(kind, m[0]):
                out.append((kind, m.start(), m.end()))
    return out


def codes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.minimum(points, 128).astype(np.int64)


def labels_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        if not out[a:b].any():
            k = KINDS.index(kind)
            out[a:b] = 2 + 2 * k
            out[a] = 1 + 2 * k
    return out


def windows_of(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an ``@``."""
    starts, last = [], -1
    top = max(0, (len(text) - 1) // STEP - 1)
    for m in EVIDENCE.finditer(text):
        for w in (m.start() // STEP - 1, m.start() // STEP):
            w = min(max(w, 0), top)
            if w > last:
                starts.append(w * STEP)
                last = w
    return starts


def cut(codes: np.ndarray, start: int, fill: int) -> np.ndarray:
    part = codes[start:start + WIDTH]
    return np.pad(part, (0, WIDTH - len(part)), constant_values=fill)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


class Tagger:
    """Bidirectional LSTM over characters and a linear-chain CRF over tags."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, INPUT
        self.w = {"embed": r.normal(0, 0.3, (CODES, d)), "out": r.normal(0, 0.2, (2 * h, TAGS)), "bias": np.zeros(TAGS),
                  "next": r.normal(0, 0.1, (TAGS, TAGS)), "first": np.zeros(TAGS)}
        for side in "fb":
            self.w |= {side + "x": r.normal(0, 0.3, (d, 4 * h)), side + "h": r.normal(0, 0.2, (h, 4 * h)),
                       side + "b": np.repeat([0.0, 1.0, 0.0, 0.0], h)}
        self.trained = False

    def run(self, codes: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (rows, places, units) of one direction; ``keep`` gets what the backward pass needs."""
        n, t = codes.shape
        table = self.w["embed"] @ self.w[side + "x"] + self.w[side + "b"]
        hidden, cell = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
        out = np.zeros((n, t, HIDDEN))
        for p in range(t) if side == "f" else range(t - 1, -1, -1):
            z = table[codes[:, p]] + hidden @ self.w[side + "h"]
            i, f, o = (sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            before, old = hidden, cell
            cell = f * old + i * g
            hidden = o * np.tanh(cell)
            out[:, p] = hidden
            if keep is not None:
                keep.append((p, i, f, o, g, old, cell, before))
        return out

    def scores(self, codes: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.run(codes, "f"), self.run(codes, "b")], 2)
        return both @ self.w["out"] + self.w["bias"]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Best tag sequences of the windows (Viterbi)."""
        s = self.scores(codes)
        n, t, _ = s.shape
        best, back = s[:, 0] + self.w["first"], []
        for p in range(1, t):
            paths = best[:, :, None] + self.w["next"]
            back.append(paths.argmax(1))
            best = paths.max(1) + s[:, p]
        tags = [best.argmax(1)]
        for step in reversed(back):
            tags.append(step[np.arange(n), tags[-1]])
        return np.stack(tags[::-1], 1)

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the gold tags and its gradients."""
        n, t = codes.shape
        kept = {"f": [], "b": []}
        hidden = np.concatenate([self.run(codes, s, kept[s]) for s in "fb"], 2)
        s = hidden @ self.w["out"] + self.w["bias"]
        ahead, nxt = np.zeros_like(s), self.w["next"]
        ahead[:, 0] = s[:, 0] + self.w["first"]
        for p in range(1, t):
            ahead[:, p] = s[:, p] + log_sum(ahead[:, p - 1][:, :, None] + nxt, 1)
        behind = np.zeros_like(s)
        for p in range(t - 2, -1, -1):
            behind[:, p] = log_sum(nxt + (s[:, p + 1] + behind[:, p + 1])[:, None, :], 2)
        whole = log_sum(ahead[:, -1], 1)
        rows = np.arange(n)
        score = self.w["first"][gold[:, 0]] + s[rows[:, None], np.arange(t), gold].sum(1) + nxt[gold[:, :-1], gold[:, 1:]].sum(1)
        ds = np.exp(ahead + behind - whole[:, None, None])
        pair = np.zeros_like(nxt)
        for p in range(1, t):
            pair += np.exp(ahead[:, p - 1][:, :, None] + nxt + (s[:, p] + behind[:, p])[:, None, :] - whole[:, None, None]).sum(0)
        np.add.at(pair, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), -1)
        ds[rows[:, None], np.arange(t), gold] -= 1
        ds, grads = ds / n, {"next": pair / n}
        grads |= {"first": ds[:, 0].sum(0), "bias": ds.sum((0, 1)), "out": np.einsum("ntk,ntj->kj", hidden, ds)}
        dh_all, embed = ds @ self.w["out"].T, np.zeros_like(self.w["embed"])
        for k, side in enumerate("fb"):
            dh_side = dh_all[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            dh, dc = np.zeros((n, HIDDEN)), np.zeros((n, HIDDEN))
            into, over = np.zeros((CODES, 4 * HIDDEN)), np.zeros_like(self.w[side + "h"])
            for p, i, f, o, g, old, cell, before in reversed(kept[side]):
                dh = dh + dh_side[:, p]
                th = np.tanh(cell)
                dc = dc + dh * o * (1 - th ** 2)
                dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g ** 2)], 1)
                np.add.at(into, codes[:, p], dz)
                over += before.T @ dz
                dh, dc = dz @ self.w[side + "h"].T, dc * f
            grads |= {side + "h": over, side + "x": self.w["embed"].T @ into, side + "b": into.sum(0)}
            embed += into @ self.w[side + "x"].T
        return float((whole - score).mean()), grads | {"embed": embed}

    def fit(self, codes: np.ndarray, gold: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Tagger:
        """Adam over batches; without rows or without a span nothing is learnt."""
        if not len(codes) or not gold.any():
            return self
        r, step = np.random.default_rng(seed), 0
        first, second = ({k: np.zeros_like(v) for k, v in self.w.items()} for _ in range(2))
        for _ in range(epochs):
            order = r.permutation(len(codes))
            for a in range(0, len(order), BATCH):
                some = order[a:a + BATCH]
                _, grads = self.gradients(codes[some], gold[some])
                size = np.sqrt(sum((g ** 2).sum() for g in grads.values()))
                step += 1
                for k, g in grads.items():
                    g = g / max(1.0, size / 5)
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g ** 2 - second[k])
                    self.w[k] -= RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
        self.trained = True
        return self


def reconciled(length: int, starts: list[int], tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a text from the tags of its windows: each place listens to one window."""
    labels = np.zeros(length, np.int64)
    quarter, top = STEP // 2, max(0, (length - 1) // STEP - 1) * STEP
    for start, row in zip(starts, tags, strict=True):
        a = 0 if start == 0 else start + quarter
        b = length if start == top else min(length, start + quarter + STEP)
        labels[a:b] = row[a - start:b - start]
    spans, at = [], 0
    inside = np.flatnonzero(labels)
    while at < len(inside):
        a = int(inside[at])
        kind, b = (labels[a] - 1) // 2, a + 1
        while b < length and labels[b] == 2 + 2 * kind:
            b += 1
        spans.append((KINDS[kind], a, b))
        at = int(np.searchsorted(inside, b))
    return spans


def trimmed(kind: str, text: str, a: int, b: int) -> tuple[int, int]:
    """The span without marks at its ends; of a card the first run of digits that is one, if there is."""
    if kind == "card":
        for m in re.finditer("[0-9]{13,19}", text[a:b]):
            if luhn(m[0]):
                return a + m.start(), a + m.end()
    value = text[a:b]
    return a + len(value) - len(value.lstrip(MARKS)), b - (len(value) - len(value.rstrip(MARKS)))


def added(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the network that stand apart, touch no span of the patterns and hold what their kind demands."""
    taken = labels_of(len(text), base) > 0
    out = []
    for kind, a, b in found:
        a, b = trimmed(kind, text, a, b)
        apart = not (text[max(0, a - 1):a] + text[b:b + 1]).strip(MARKS + "\"'\n\t") and ALLOWED[kind].fullmatch(text, a, b)
        if a < b and apart and not taken[a:b].any() and holds(kind, text[a:b]):
            out.append((kind, a, b))
    return out


def training_windows(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """codes, tags of at most ``sample`` windows that hold a digit or an ``@``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = {"order": [], "codes": [], "tags": []}
            for text in batch["text"]:
                starts = windows_of(text)
                if starts:
                    codes, tags = codes_of(text), labels_of(len(text), base_spans(text))
                    for s in starts:
                        c, g = cut(codes, s, CODES - 1).astype(np.uint8).tobytes(), cut(tags, s, 0).astype(np.uint8).tobytes()
                        rows["order"].append(int.from_bytes(hashlib.blake2b(c, digest_size=7).digest(), "big"))
                        rows["codes"].append(c)
                        rows["tags"].append(g)
            yield pd.DataFrame(rows)

    some = thinned(docs.select("text").where(F.col("text").rlike("[0-9@]")), F.col("text"), sample)
    return some.mapInPandas(run, "order long, codes binary, tags binary").dropDuplicates(["order"]).orderBy("order").limit(sample)


def train(docs: DataFrame, sample: int = SAMPLE) -> Tagger:
    rows = training_windows(docs, sample).toPandas()

    def table(values) -> np.ndarray:
        return np.array([np.frombuffer(bytes(v), np.uint8) for v in values], np.int64).reshape(len(rows), WIDTH)

    return Tagger().fit(table(rows["codes"]), table(rows["tags"]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans of every document.

    The four counts are those of the patterns; ``n_added`` counts what only the network found.
    """
    tagger = tagger or train(docs)
    rows = small_batches(docs.select("doc_id", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            starts = [windows_of(t) for t in texts] if tagger.trained else [[] for _ in texts]
            codes = [cut(c, s, CODES - 1) for t, w in zip(texts, starts, strict=True) if w for c in [codes_of(t)] for s in w]
            parts = [tagger.decode(np.array(codes[a:a + 512])) for a in range(0, len(codes), 512)]
            tags = np.concatenate(parts) if parts else np.zeros((0, WIDTH), np.int64)
            out, at = [], 0
            for text, w in zip(texts, starts, strict=True):
                base = base_spans(text) if EVIDENCE.search(text) else []
                more = added(text, base, reconciled(len(text), w, tags[at:at + len(w)])) if w else []
                at += len(w)
                spans = sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))
                out.append((*(sum(s[0] == k for s in base) for k in KINDS), len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            frame = pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])
            frame.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield frame

    return rows.mapInPandas(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, "
                                 "n_phone long, n_added long, base_sha256 string, spans string")


shipped(__name__)
