import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from gridloom.llm.queries import op3_token_counts
from gridloom.llm.token_counts import Counter, token_counts, vocabulary
from tests.conftest import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


def library(pieces):
    """The same vocabulary in a library that segments whole texts, with byte pieces that nothing in these texts matches."""
    special = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1.0) for b in range(256))]
    low = min(s for _, s in pieces)
    tokenizer = Tokenizer(models.Unigram([*special, *pieces], unk_id=0, byte_fallback=True))
    assert low <= -1.0
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always", split=False)
    return lambda text: len(tokenizer.encode(text).ids)


def test_small_vocabulary_with_ties():
    rng = random.Random(8)
    for _ in range(30):
        pieces = [(p, float(-rng.randrange(1, 5))) for p in {"".join(rng.choice("abé▁") for _ in range(rng.randrange(1, 4))) for _ in range(12)}]
        counter, count = Counter(pieces), library(pieces)
        for _ in range(60):
            text = "".join(rng.choice("abcé \n☃") for _ in range(rng.randrange(16)))
            assert counter.text(text) == count(text), (pieces, text)


def test_public_vocabulary_on_real_texts(spark):
    pieces = vocabulary(PATH)
    count = library(pieces)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_token_counts(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_chars, r.n_tokens) == (len(texts[r.doc_id]), count(texts[r.doc_id]))


def plain(pieces):
    """An own whole-text Viterbi: every piece at every place; the piece that starts first wins a tie."""
    scores, longest, unknown = dict(pieces), max(len(p) for p, _ in pieces), min(s for _, s in pieces) - 10

    def count(text):
        text = ("" if text[:1] in ("", " ") else "▁") + text.replace(" ", "▁")
        best = [(0.0, 0)] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - longest), end):
                piece = text[start:end]
                if piece in scores or (end - start == 1):
                    score, many = (scores[piece], 1) if piece in scores else (unknown, len(piece.encode()))
                    if best[end] is None or best[start][0] + score > best[end][0]:
                        best[end] = best[start][0] + score, best[start][1] + many
        return best[-1][1]

    return count


def test_runs_of_spaces_against_whole_texts():
    rng = random.Random(5)
    for _ in range(30):
        pieces = [(p, float(-rng.randrange(1, 9))) for p in {"".join(rng.choice("ab▁▁") for _ in range(rng.randrange(1, 5))) for _ in range(14)}]
        counter, count = Counter(pieces), plain(pieces)
        for _ in range(60):
            text = "".join(rng.choice("abc  \n") for _ in range(rng.randrange(20)))
            assert counter.text(text) == count(text), (pieces, text)
    pieces = vocabulary(PATH)
    counter, count, whole = Counter(pieces), plain(pieces), library(pieces)
    for text in ("x    y", "end  ", "the   cat  sat", "   a", " " * 40 + "b", "a  \n   b  "):
        assert counter.text(text) == count(text) == whole(text)
    for _ in range(200):
        text = "".join(rng.choice(["the", "cat ", "  ", " ", "    ", "\n", "é", "☃", "x" * 5]) for _ in range(rng.randrange(12)))
        assert counter.text(text) == whole(text)


def test_edges(spark):
    rows = [(1, None), (2, ""), (None, " "), (3, "  a\n\nb "), (3, "  a\n\nb "), (4, "ab" * 50000), (5, "☃\u0000")]
    count = library(vocabulary(PATH))
    found = token_counts(spark.createDataFrame([(i if i is None else str(i), t) for i, t in rows], "doc_id string, text string"), PATH).collect()
    assert sorted(map(str, found)) == sorted(f"Row(doc_id={i if i is None else repr(str(i))}, n_chars={len(t or '')}, n_tokens={count(t or '')})" for i, t in rows)
    assert token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
