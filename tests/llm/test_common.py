import numpy as np

from gridloom.llm import common
from gridloom.llm.common import NOT_ALNUM, SPACES, crc_mod, hashed_words, pack_texts, stage, unpack_texts


def test_hashes_follow_words_alone():
    texts = [b"One two  TWO\tone\x0bthree", b"", b" \n ", "é two ÉÉ".encode(), b"three"]
    docs, words = hashed_words(texts, SPACES)
    assert docs.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 4]
    one, two, three = words[[0, 1, 4]]
    assert words.tolist()[:5] == [one, two, two, one, three] and words[6] == two and words[8] == three
    assert len(set(words.tolist())) == 5
    docs, words = hashed_words([b"a-b a.b", b"ab"], NOT_ALNUM)
    assert docs.tolist() == [0, 0, 0, 0, 1] and len(set(words.tolist())) == 3


def test_slices_change_nothing(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [" ".join(str(x) for x in rng.integers(0, 99, n)).encode() for n in (3, 4000, 0, 50)] + [b"x" * 3000 + b" y"]
    whole = hashed_words(texts, SPACES)
    for size in (7, 64, 1000):
        monkeypatch.setattr(common, "SLICE", size)
        again = hashed_words(texts, SPACES)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))


def test_packed_texts():
    texts = [b"", b"abc", "é\n".encode() * 9]
    assert unpack_texts(pack_texts(texts)) == texts and unpack_texts(pack_texts([])) == []


def test_stage_and_crc(spark):
    import zlib

    df = spark.range(50).selectExpr("if(id = 7, null, id) as doc_id")
    kept = stage(df, "test")
    assert kept.schema == df.schema and kept.count() == 50
    for r in kept.select("doc_id", crc_mod("doc_id", 7).alias("m")).collect():
        assert r.m == zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 7
