"""Whitening, source divergence and substring dedup: against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from compare import compare, connect
from prosa.llm import divergence, substring_dedup, whitening
from prosa.llm.common import word_hashes
from prosa.llm.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType())] + [T.StructField(c, T.StringType()) for c in ("h", "key", "term", "n", "docs", "first", "kept", "col")])
VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("w", T.StringType()),
                        T.StructField("c", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 8) for r in rows], DOCS)


# --- words and substring dedup ----------------------------------------------------------------

def test_word_hashes():
    text = "a b  a\tab\nba \x1c é　x \r\na"
    words = text.encode().split()
    h, start = word_hashes(text.encode())
    assert len(h) == len(words)
    for i, w in enumerate(words):
        assert text.encode()[start[i]:start[i] + len(w)] == w
        for j, v in enumerate(words):
            assert (h[i] == h[j]) == (w == v)
    many = " ".join(f"w{i % 5000}" for i in range(600_000)).encode()  # several pieces
    h, start = word_hashes(many)
    assert len(h) == 600_000 and len(np.unique(h)) == 5000 and (h[:5000] == h[5000:10000]).all()
    assert len(word_hashes(b"")[0]) == len(word_hashes(b" \n")[0]) == 0
    assert len(word_hashes(b"y" * 3_000_000)[0]) == 1


def expected(rows, words):
    first = {}
    for i, text in rows:
        w = WORD.findall(text or "")
        for j in range(len(w) - words + 1):
            k = tuple(w[j:j + words])
            if i is not None:
                first[k] = min(first.get(k, i), i)
    out = []
    for i, text in rows:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for j in range(len(w) - words + 1):
            if i is not None and first[tuple(w[j:j + words])] < i:
                gone[j:j + words] = [True] * words
        out.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), sum(gone)))
    return sorted(out, key=str)


def odd_texts():
    rng = np.random.default_rng(3)
    word = lambda n: " ".join(rng.choice([f"v{i}" for i in range(400)], n))
    passage, short, long_text = word(60), word(12), word(30_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, passage), (None, None), (4, passage), (5, word(20) + " " + passage + "\n" + word(5)), (5, passage + " " + word(3)),
            (6, short), (7, short + " " + word(30)), (8, passage.upper()), (9, "a " * 200), (10, "a " * 13), (11, long_text), (12, word(7) + " " + long_text), (12, word(7) + " " + long_text)]
    return rows + [(100 + i, passage + " " + word(i)) for i in range(40)]


@pytest.mark.parametrize("words", [1, 5, 13, 50])
def test_substring_dedup(spark, words):
    rows = odd_texts()
    out = substring_dedup.substring_dedup(documents(spark, [(*r, "en", "a") for r in rows]), words).collect()
    assert sorted([(r.doc_id, r.kept, r.n_words, r.n_removed) for r in out], key=str) == expected(rows, words)
    for r in out:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed


def test_substring_dedup_full_map(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SMALLEST", 3)
    monkeypatch.setattr(substring_dedup, "LARGEST", 3)
    rows = odd_texts()
    out = substring_dedup.substring_dedup(documents(spark, [(*r, "en", "a") for r in rows])).collect()
    assert sorted([(r.doc_id, r.kept, r.n_words, r.n_removed) for r in out], key=str) == expected(rows, 13)


def test_substring_dedup_nothing(spark):
    assert substring_dedup.substring_dedup(documents(spark, [])).count() == 0
    out = substring_dedup.substring_dedup(documents(spark, [(1, "a b", "en", "a"), (2, "c d", "en", "a")])).collect()
    assert sorted((r.doc_id, r.kept, r.n_removed) for r in out) == [(1, "a b", 0), (2, "c d", 0)]


def test_op13(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = sorted([tuple(r) for r in QUERIES["op13_substring_dedup"](spark, DATA).collect()], key=str)
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, kept, n, gone in expected(rows, 13)]
    assert got == sorted(want, key=str) and any(r[2] for r in got)


# --- divergence --------------------------------------------------------------------------------

@pytest.mark.parametrize("n,width,share", [(1, 1, 1.0), (2, 0, 0.0), (3, 5, 0.4), (7, 300, 0.01), (20, 65, 0.3), (41, 1100, 0.02), (9, 20, 0.0)])
def test_distances(n, width, share):
    rng = np.random.default_rng(n)
    zero = rng.integers(1, 50, n)
    p = np.repeat(zero[:, None], width, axis=1)
    row, col = np.nonzero(rng.random((n, width)) < share)
    p[row, col] += rng.integers(1, 100, len(row))
    got = divergence.distances(row, col, p[row, col], zero, width)
    want = np.abs(p[:, None, :] - p[None, :, :]).sum(axis=2)
    upper = np.triu_indices(n, 1)
    assert (got[upper] == want[upper]).all()


def audited(rows, least, top, scale, smooth):
    """The contract, spelled out over Python numbers."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        found = [t.translate(lower) for t in term.findall(text or "")]
        n[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
        groups[lang or ""].add(source or "")
    out = []
    for lang, sources in groups.items():
        kept = [t for t, c in docs[lang].items() if c >= least]
        all_ = Counter({t: sum(n[lang, s][t] for s in sources) for t in kept})
        price = lambda c, total: 1 + scale * (c + smooth) // (total + smooth * len(kept))
        p = {s: {t: price(n[lang, s][t], sum(n[lang, s][k] for k in kept)) for t in kept} for s in sources}
        q = {t: price(all_[t], sum(all_.values())) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            more = [(t, p[s][t] - q[t]) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", more, top)):
                order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]
    return sorted(out)


def test_divergence(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["É", "naïve", "ÀB", "Zed", "zed", "中文", *[f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(0, 60)))) + " x-y_z1É", ["en", "de", None, ""][i % 4], [None, "", "a", *[f"s{k}" for k in range(20)]][int(rng.integers(0, 23))])
            for i in range(300)]
    rows += [(1, None, "en", "only null"), (2, "", "xx", "a"), (3, None, "xx", "b"), (4, "one", "yy", "single")]
    frame = documents(spark, rows)
    for block in (divergence.BLOCK, 7):  # several blocks of groups as well
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "STRIP", 100 if block == 7 else 1024)
        got = sorted(tuple(r) for r in divergence.divergence(frame, 3, 5, 1000, 2).collect())
        assert got == audited(rows, 3, 5, 1000, 2)
    assert divergence.divergence(documents(spark, [])).count() == 0


def test_op12(spark):
    assert compare(spark, connect(DATA), "op12_source_divergence", QUERIES, ORACLE, DATA) is None


# --- whitening -----------------------------------------------------------------------------------

@pytest.mark.parametrize("kind", ["random", "clusters", "diagonal", "nearly equal", "one large", "zero", "block"])
@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
def test_leading(kind, n):
    rng = np.random.default_rng(n)
    b = rng.normal(size=(n, n))
    q, _ = np.linalg.qr(b)
    a = {"random": b @ b.T, "clusters": q @ np.diag(np.repeat([5.0, 2.0, 1.0], n)[::3][:n]) @ q.T, "diagonal": np.diag(rng.integers(1, 4, n).astype(float)),
         "nearly equal": q @ np.diag(1 + 1e-13 * np.arange(n)) @ q.T, "one large": np.outer(b[0], b[0]) + 1e-6 * np.eye(n), "zero": np.zeros((n, n)),
         "block": np.kron(np.eye(2), b @ b.T)}[kind]
    a = (a + a.T) / 2
    values, vectors = whitening.leading(a, 8)
    true = np.linalg.eigvalsh(a)[::-1][:len(values)]
    size = max(np.abs(true).max(), 1e-300)
    assert len(values) == min(8, len(a)) and np.abs(values - true).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def whitened(rows):
    """n, deviations, whitened up to sign, explained."""
    good = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dims = max(len(v) for _, v in good)
    x = np.array([[int(np.floor(float(np.float32(c)) * 1024)) + 100_000 for c in [*v, *[0.0] * (dims - len(v))]] for _, v in good], object)
    n, s = len(x), x.sum(axis=0)
    d = n * x - s
    centred = (d / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:8], vectors[:, ::-1][:, :8]
    return good, n, [sum(v * v for v in row) for row in d], centred @ vectors / np.sqrt(values), values / np.trace(cov)


def test_whiten(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=12) * np.arange(1, 13)]) for i in range(500)]
    rows += [(500, rows[0][1]), (0, rows[1][1]), (None, rows[2][1]), (600, None), (601, [float("nan")] * 12), (602, [None] + [1.0] * 11), (603, [float("inf")] + [1.0] * 11), (604, [1.0] * 5)]
    out = whitening.whiten(spark.createDataFrame([(*r, "x", "x") for r in rows], VECTORS)).toPandas()
    good, n, deviation, w, share = whitened(rows)
    assert len(out) == 8 * len(good) and set(out["n"]) == {n}
    assert Counter(out["deviation"]) == Counter({v: 8 * c for v, c in Counter(deviation).items()})
    assert out["identity_error"].nunique() == 1 and out["identity_error"][0] < 1e-10
    for k in range(8):
        mine = out[out["component"] == k + 1]
        assert np.allclose(mine["explained"], share[k], rtol=1e-10)
        by_deviation = mine.sort_values("deviation")["whitened"].to_numpy()
        true = w[np.argsort(np.array(deviation, float), kind="stable"), k]
        assert np.allclose(np.sort(np.abs(by_deviation)), np.sort(np.abs(true)), atol=1e-9)


def test_whiten_edges(spark):
    frame = lambda rows: spark.createDataFrame([(*r, "x", "x") for r in rows], VECTORS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [None])])).count() == 0
    assert whitening.whiten(frame([(1, [])])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, -0.5])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in sorted(one, key=lambda r: r.component)] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    flat = whitening.whiten(frame([(i, [float(i), float(2 * i), 1.0]) for i in range(4)])).collect()
    assert {(r.component, r.whitened is None) for r in flat} == {(1, False), (2, True), (3, True)}
    huge = whitening.whiten(frame([(i, [3e38 * (i % 2), float(i)]) for i in range(4)])).collect()
    assert {r.deviation for r in huge} == {None} and len(huge) == 8


def test_squares():
    rng = np.random.default_rng(0)
    for size in (10, 1 << 30, (1 << 50) - 1, 1 << 55):
        d = rng.integers(-size, size, (5, 7))
        want = [sum(int(v) ** 2 for v in row) for row in d]
        assert whitening.squares(d) == whitening.squares(d.astype(object)) == [v if v < 1 << 63 else None for v in want]


def test_op11(spark):
    out = QUERIES["op11_whitening"](spark, DATA).toPandas()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert len(out) == 8 * rows and out["identity_error"].max() < 1e-9


