import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm.packing import pack, plan, slots
from gridloom.llm.queries import tokenizer_path


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_length_once(seed):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(4096, np.exp(rng.normal(4 + seed, 1.2, 5000)).astype(int) + 1)
    got = Counter()
    for b in plan(Counter(lengths.tolist())):
        assert b.room == 4096 - sum(n * c for n, c in b.items) >= 0
        for n, c in b.items:
            got[n] += c * b.count
    assert got == Counter(lengths.tolist())
    assert len(slots(plan(Counter(lengths.tolist())))["at"])


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    lengths = np.minimum(4096, np.exp(rng.normal(6.2, 1.1, 20000)).astype(int) + 1)
    assert sum(b.count for b in plan(Counter(lengths.tolist()))) <= 1.01 * lengths.sum() / 4096 + 1
    assert plan({}) == []


def special_tokens():
    import json

    with open(tokenizer_path()) as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def test_pack_equals_the_tokenizer(spark):
    """Ids (by their crc32), lengths and starts of every piece against the tokenizer on the whole text, with special tokens, in mixed case
    too, cuts at 4096, and random joins of awkward parts."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    special = special_tokens()
    assert special
    rng = random.Random(0)
    parts = [*special, *(t.lower() for t in special), *(t.title() for t in special), *(t.upper() for t in special), "Hello", "wORLD", " ", "  ", "\n", "\n\n", "\t", "It's", "42", "...", "ÉTÉ", "日本", "🙂", "a" * 50, "é", "\x00", "\u00a0", "<", ">", "|"]
    texts = [None, "", "Hello, world. It's 42!", "x " * 9001, "Äpfel ÉTÉ\n\n...", "same", "same", " \t ", *parts, *("a" + t + "b" for t in special)]
    texts += ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(200)] + [" ".join(rng.choices(parts, k=9000))]
    exact = next(n for n in range(4000, 4200) if len(whole.encode("x " * n, add_special_tokens=False).ids) == 4095)
    texts += ["x " * exact, "x " * (exact + 1)]  # with the end token, 4096 and one more
    docs = spark.createDataFrame([(i if i != 5 else None, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = pack(docs, tokenizer_path()).collect()
    expected = []
    for i, t in enumerate(texts):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 1]
        expected += [(i if i != 5 else -1, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    found = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    assert found == sorted(expected) and max(p for _, p, *_ in found) > 1
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 4096


def test_pack_of_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0
