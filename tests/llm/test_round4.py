"""What moves and what is repeated work in the corpus operators: less of it, with the same results."""

import random

import numpy as np
from pyspark.sql import functions as F

from prosa.llm import bpe, jaccard, line_dedup
from prosa.llm.queries import tokenizer_file


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_jaccard_sets_move_only_for_pairs_that_can_link(spark):
    rng, levels = np.random.default_rng(3), [1, 2, 3, 4, 7, 8, 15, 16, 40, 128, 700]
    sets = []
    for n in levels * 3:
        base = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        sets += [base, np.unique(np.concatenate([base[rng.random(len(base)) > 0.08], rng.integers(0, 1 << 64, n // 12, np.uint64)]))]
    sets = [s for s in sets if len(s)]
    for part in (80, 85, 40):
        can = jaccard.may_link([jaccard.sketch_of(s) for s in sets], [jaccard.sketch_of(s) for s in sets], part, 100)
        assert not (jaccard.linked_in_block(sets, sets, part, 100) & ~can).any()
    assert jaccard.sketch_of(np.arange(300, dtype=np.uint64)) is None and jaccard.may_link([None], [b"\1\1"], 85, 100).all()

    words = random.Random(4)
    shared = " ".join(f"s{words.random()}" for _ in range(60))
    docs = [(i, shared + " " + " ".join(f"w{words.random()}" for _ in range(300))) for i in range(12)]
    docs += [(i + 20, text + " z") for i, text in docs[:2]]
    rows = jaccard.classes_of(frame(spark, docs)).persist()
    sketches = rows.select("cls", "sketch")
    pairs = sketches.select(F.col("cls").alias("leader")).join(sketches.select("cls")).where("leader < cls")
    names = {r["cls"]: r["doc_id"] for r in rows.collect()}
    found = {tuple(sorted((names[r["leader"]], names[r["cls"]]))) for r in jaccard.that_may_link(pairs, sketches, 85, 100).collect()}
    assert found == {(0, 20), (1, 21)}  # of 91


def test_line_dedup_moves_only_texts_that_may_lose_words(spark, monkeypatch):
    words = random.Random(7)
    passage = " ".join(f"p{words.random()}" for _ in range(70))
    docs = [(i, "\n".join(f"w{words.random()} \t\n é" for _ in range(30))) for i in range(40)] + [(50, "a b " + passage), (51, "c\n\n" + passage + " d"), (52, None)]
    out = line_dedup.line_dedup(frame(spark, docs))
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[51]["n_deleted"] == 1 and rows[51]["n_words_left"] == 2 and sum(r["n_deleted"] for r in rows.values()) == 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    still, moved = plan[plan.index("Union"):].split("Join", 1)  # one branch has no join, and its rows no exchange
    assert still.count("without") and moved.count("without") == 0
    assert [(r["doc_id"], [c >> 32 for c in r["cuts"]], [c & 0xFFFFFFFF for c in r["cuts"]]) for r in line_dedup.later_copies(frame(spark, docs)).collect()][0][0] == 51

    monkeypatch.setattr(line_dedup, "PIECE", 200)
    for (_, text), (h, start, data) in zip(docs, line_dedup.hashed([t for _, t in docs]), strict=True):
        found = (text or "").encode().split()
        assert data == (text or "").encode() and [data[a:a + len(w)] for a, w in zip(start, found, strict=True)] == found
        assert len(set(h.tolist())) == len(set(found))


def test_bpe_keeps_words_that_come_again(monkeypatch):
    with open(tokenizer_file(), encoding="utf-8") as f:
        coder, whole = bpe.Coder(definition := f.read()), bpe.Coder(definition)
    monkeypatch.setattr(bpe, "REMEMBER", 60)
    seen, encode_words = [], coder.encode_words
    coder.encode_words = lambda words: encode_words(seen.extend(words := list(words)) or words)
    for k in range(12):
        text = " ".join(["again", "über.\nNew", "it's", "\0x"] + [f"once{chr(97 + k)}{chr(97 + j)}" for j in range(25)]) + " <|endoftext|>"
        assert coder.encode([text, "", text]) == [whole.encode([t])[0] for t in (text, "", text)]
        assert coder.decode(coder.encode([text])[0]) == text
    assert seen.count(" again") + seen.count("again") == 1 and seen.count(" it") == 1 and len(seen) == len(set(seen))
    assert len(coder.known) + len(coder.older) < 4 * 60
