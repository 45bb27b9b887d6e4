import sys

from prosa.llm import bpe
from prosa.llm.queries import tokenizer_file


def test_bpe_remembers_packed_ids():
    """What a worker keeps of a word is its ids as packed integers: an executor has more workers than cores."""
    with open(tokenizer_file(), encoding="utf-8") as f:
        coder = bpe.Coder(f.read())
    text = " ".join(f"wörd{chr(97 + a)}{chr(97 + b)} x{chr(97 + a)}, {a}{b}." for a in range(26) for b in range(26))
    ids = coder.encode([text, "", text])
    assert ids[0] == ids[2] and len(ids[1]) == 0 and coder.decode(ids[0]) == text
    kept = sum(len(coder.encode([u])[0]) for u in list(coder.known))
    assert sum(map(sys.getsizeof, coder.known.values())) <= 40 * len(coder.known) + 4 * kept
