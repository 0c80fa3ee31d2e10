import random
import re

from gridloom.llm import licenses
from gridloom.llm.licenses import STEP, TEMPLATES, WIDTH, WINDOW, scan
from tests.conftest import SF


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered) if w]


def shingles(w):
    return {tuple(w[k : k + WIDTH]) for k in range(len(w) - WIDTH + 1)}


def exact(text, percent=80, templates=TEMPLATES):
    """Templates of which enough shingles are anywhere in the text: what windows can find at most."""
    own = shingles(words(text))
    return sorted(n for n, t in templates if (s := shingles(words(t))) and 100 * len(s & own) >= percent * len(s))


def found(df):
    return sorted(((r.doc_id, r.licenses) for r in df.collect()), key=str)


def test_real_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = sorted(((r.doc_id, exact(r.text)) for r in docs.collect()), key=str)
    assert found(scan(docs)) == expected and any(x for _, x in expected)


def test_parts_and_templates_of_one_name(spark, monkeypatch):
    templates = [*TEMPLATES, ("MIT", dict(TEMPLATES)["MIT-grant"])]
    docs = spark.createDataFrame([(k, f"so {t} it is", "x") for k, (_, t) in enumerate(templates)], "doc_id long, text string, licenses string")
    whole = found(scan(docs, templates))
    assert [x for k, x in whole if k in (8, 9)] == [["MIT"], ["MIT", "MIT-grant"]]
    monkeypatch.setattr(licenses, "PART_BYTES", 300)
    assert len(licenses.parts_of(templates)) > 3 and found(scan(docs, templates)) == whole


def test_planted_notices(spark):
    rng = random.Random(3)
    rows = []
    for k in range(80):
        noise = [f"n{rng.randrange(400)}" for _ in range(rng.randrange(60))]
        name, text = TEMPLATES[k % len(TEMPLATES)]
        own = text.split() if k % 5 else text.split()[: len(text.split()) // 3]
        at = rng.randrange(len(noise) + 1)
        rows.append((k, " ".join(noise[:at] + own + noise[at:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(scan(docs)) == sorted(((i, exact(t)) for i, t in rows), key=str)
    assert WINDOW - STEP + 1 >= 9


def test_edges(spark):
    mit = dict(TEMPLATES)["MIT"]
    rows = [(1, None, 1), (2, "", 2), (None, mit, 3), (3, mit, 4), (3, mit, 4), (4, "the MIT", None), (5, "x " * 30000 + mit.upper() + " y" * 9, 6), (6, "ß ☃ " + mit, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses int")
    got = scan(docs)
    assert got.columns == ["doc_id", "text", "licenses"]
    assert found(got) == sorted(((i, exact(t)) for i, t, _ in rows), key=str)
    assert scan(spark.createDataFrame([], docs.schema)).count() == 0
    assert found(scan(docs, templates=[("x", "two words")])) == sorted(((i, []) for i, _, _ in rows), key=str)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
