import random

from prosa.llm import bpe, line_dedup
from prosa.llm.queries import tokenizer_file
from tests.llm.test_round4 import frame


def test_line_dedup_has_one_python_step_a_stage(spark):
    """Every further one would be one more Python process for each core, which stays for the stages that follow."""
    rng = random.Random(6)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(80))
    docs = [(i, passage if i in (3, 7) else f"just {i}\n\nwords {i}") for i in range(12)]
    out = line_dedup.line_dedup(frame(spark, docs))
    rows = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert rows[7]["n_words_left"] == 0 and rows[3]["n_words_left"] == 80 and rows[3]["text"] == passage
    assert rows[0] == {"doc_id": 0, "text": "just 0\n\nwords 0", "n_lines": 2, "n_deleted": 0, "n_words": 4, "n_words_left": 4}
    # Below a Python step, as far as the next exchange, is no other one.
    steps = []
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    for line in plan.splitlines():
        name = line.lstrip(" :+-*")
        depth = len(line) - len(name)
        while steps and steps[-1][0] >= depth:
            steps.pop()
        above = steps[-1][1] if steps else 0
        here = 0 if "Exchange" in name or "ShuffleQueryStage" in name else above + ("EvalPython" in name)
        assert here <= 1, plan
        steps.append((depth, here))
    assert "EvalPython" in plan


def test_bpe_returns_memory(monkeypatch):
    """Workers take turns: one that waits must not keep what it has freed."""
    import pandas as pd

    given = []
    monkeypatch.setattr(bpe, "give_back", lambda: given.append(1))
    monkeypatch.setattr(bpe, "BLOCK", 100)
    with open(tokenizer_file(), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    batch = pd.DataFrame({"doc_id": range(10), "text": ["some words here " * 10] * 10})
    coded = [c for _, some in coder.batches([batch]) for c in some]
    assert len(coded) == 10 and len(given) == 10 // bpe.RETURN + 1
