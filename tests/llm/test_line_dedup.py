import hashlib
import random
import re

from gridloom.llm import line_dedup
from gridloom.llm.line_dedup import dedup_lines
from tests.conftest import SF


def number(x):
    return int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % (2**31 - 1)


def lines_of(text):
    return text.split("\n")


def cut(t, mean):
    """(first, n) of the chunks that are looked for."""
    ends = [
        i for i in range(1, len(t) + 1)
        if i == len(t) or len(t[i - 1]) >= 60 or len(t[i]) >= 60 or ((number(t[i - 2]) if i > 1 else 0) * 1_000_003 + number(t[i - 1])) % (2**31 - 1) % mean == 0
    ]
    found, first = [], 0
    for end in ends:
        found += [(s, min(64, end - s)) for s in range(first, end, 64)]
        first = end
    return [(f, n) for f, n in found if n >= 2 or len(t[f]) >= 60]


def words(text):
    return len(re.findall(r"[^\x09-\x0D ]+", text))


def brute(rows, mean=2, min_words=20):
    """rows: distinct (doc_id, text). (doc_id, text) -> new text."""
    raw = {r: lines_of(r[1]) for r in rows if r[1] is not None}
    docs = raw
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    chunks = {r: cut(t, mean) for r, t in docs.items()}
    places = {}
    for r in order:
        for f, n in chunks[r]:
            places.setdefault(tuple(docs[r][f : f + n]), []).append((r, f))
    result = {}
    for r in order:
        t, gone = docs[r], set()
        chosen = [(f, n) for f, n in chunks[r] if len(places[tuple(t[f : f + n])]) > 1]
        for k, (f, n) in enumerate(chosen):
            kr, kf = places[tuple(t[f : f + n])][0]
            if (kr, kf) == (r, f):
                continue
            at, kat = chunks[r].index((f, n)), chunks[kr].index((kf, n))
            low = max(chunks[r][at - 1][0] - 1 if at else 0, 0, sum(chosen[k - 1]) if k else 0)
            high = chunks[r][at + 1] if at + 1 < len(chunks[r]) else (len(t), 0)
            high = min(sum(high), chosen[k + 1][0] if k + 1 < len(chosen) else sum(high))
            klow = max(chunks[kr][kat - 1][0] - 1, 0) if kat else 0
            khigh = sum(chunks[kr][kat + 1]) if kat + 1 < len(chunks[kr]) else len(docs[kr])
            gone.update(range(f, f + n))
            i = 1
            while f - i >= low and kf - i >= klow and t[f - i] == docs[kr][kf - i]:
                gone.add(f - i)
                i += 1
            i = n
            while f + i < high and kf + i < khigh and t[f + i] == docs[kr][kf + i]:
                gone.add(f + i)
                i += 1
        runs, removed = [], []
        for i in sorted(gone):
            if runs and runs[-1][-1] == i - 1:
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            if words("\n".join(raw[r][i] for i in run)) >= min_words:
                removed += run
        result[r] = "\n".join(x for i, x in enumerate(raw[r]) if i not in set(removed))
    return result


def check(spark, rows, mean=2, min_words=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hash string")
    got = dedup_lines(docs, mean, min_words)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    expected = brute({(r[0], r[1]) for r in rows}, mean, min_words)
    out = got.collect()
    want = sorted(((d, expected.get((d, t)) if t is not None else None, h) for d, t, _, h in rows), key=repr)
    assert sorted(((r.doc_id, r.text, r.hash) for r in out), key=repr) == want
    return out


def test_random_documents_against_brute_force(spark):
    rng = random.Random(4)
    for mean, least in ((2, 3), (3, 1)):
        rows = []
        for doc in range(60):
            lines = [rng.choice("abcdefgh") * rng.choice([1, 1, 1, 70]) for _ in range(rng.randrange(18))]
            rows.append((doc, "\n".join(lines), None, f"x{doc}"))
        check(spark, rows, mean, least)


def passage(rng, many):
    """Lines of 2 to 70 words, `many` words at least."""
    out = []
    while sum(map(len, out)) < many:
        out.append([f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(2, rng.choice([10, 70])))])
    return "".join(" ".join(s) + "\n" for s in out)


def test_planted_passages_go_and_clean_texts_stay(spark):
    """Passages of over 50 words, in several documents each, between texts of their own; and copies, of which the first stays."""
    rng = random.Random(11)
    passages = [passage(rng, 51) for _ in range(40)]
    rows, where = [], []
    for doc in range(240):
        own = [passage(rng, rng.randrange(80, 200)) for _ in range(2)]
        k = rng.randrange(120)
        rows.append((doc, own[0] + (passages[k] if k < 40 else "Home\nAbout us\nContact\n") + own[1], None, "x"))
        where.append(k)
    base = passage(rng, 300)
    copies = [(1000 + k, base if k < 3 else base.replace(base.split(" ")[10 * k], "changed"), None, "c") for k in range(6)]
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows + copies, "doc_id long, text string, n_chars int, hash string")).collect()}
    first, total, gone = set(), 0, 0
    for (doc, text, *_), k in zip(rows, where, strict=True):
        if k >= 40 or k not in first:
            assert out[doc] == text
            first.add(k)
        else:
            total += 1
            gone += out[doc] == text.replace(passages[k], "")
    assert total > 30 and gone >= 0.97 * total
    assert out[1000] == base and out[1001] == out[1002] == ""
    assert all("changed" in out[1000 + k] and words(out[1000 + k]) < 0.5 * words(base) for k in range(3, 6))


def test_a_text_stitched_from_others_loses_what_they_have(spark):
    rng = random.Random(5)
    parts = [passage(rng, 300) for _ in range(3)]
    rows = [(k, passage(rng, 60) + "\n" + p + "\n" + passage(rng, 60), None, "x") for k, p in enumerate(parts)]
    taken = ["\n".join(p.split("\n")[: len(p.split("\n")) * 2 // 3]) for p in parts]
    own = passage(rng, sum(map(words, taken)) * 2 // 3)  # so three fifths of the text are of others
    rows.append((9, "\n".join([*taken, own]), None, "x"))
    out = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_chars int, hash string")).collect()}
    assert all(out[k] == rows[k][1] for k in range(3))
    assert own in out[9] and words(out[9]) <= words(own) + 20 and not any(t in out[9] for t in taken)


def test_keys_of_null_ids_and_of_ids_within_texts(spark):
    a, b = ("\n".join(f"{c} line {k} of a text with some words." for k in range(9)) for c in "ab")
    rows = [(5, a, 1, "x"), (None, "5|" + a, 1, "y"), (None, "1|5|" + b, 1, "z"), (5, b, 1, "w")]
    check(spark, rows)


def test_edges(spark):
    body = "\n".join(f"one line of some words, of which this is number {k}." for k in range(8))
    rows = [
        (None, body, 3, "n"),
        (1, None, None, "a"),
        (2, "", 0, "b"),
        (3, "\n\n\n", 3, "c"),
        (4, "\n\n\n", 3, "d"),
        (5, body, None, "e"),
        (5, body, None, "f"),
        (6, "single", 6, "g"),
        (7, "single", 6, "h"),
        (8, "\n".join(map(str, range(20000))), 1, "i"),
        (9, "word " * 250_000, 1, "j"),
    ]
    out = {r.hash: r for r in check(spark, rows)}
    assert out["n"].text == body and out["e"].text == out["f"].text == "" and out["g"].text == out["h"].text == "single"
    assert out["i"].n_chars == 1 and out["a"].text is None
    check(spark, rows)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string, n_chars int, hash string")).count() == 0


def test_real_table_against_brute_force_and_sql(spark):
    import duckdb

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(docs.select("doc_id", "text"), count_columns=True).collect()}
    expected = brute({(r.doc_id, r.text) for r in docs.collect()})
    assert {i: t for i, (t, _, _) in got.items()} == {i: t for (i, _), t in expected.items()} and any(n for _, _, n in got.values())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    assert {r[0]: tuple(r[1:]) for r in con.execute(line_dedup.ORACLE).fetchall()} == got


def test_no_python_in_the_plan(spark):
    plan = dedup_lines(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan.replace("gridloom", "")
