import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from gridloom.llm.repair import BLANK, CUT, FINE, REPEATED, Composition, audits, damage, digests, repair
from tests.conftest import SF

GRAMMAR = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, place long, n int"


def brute_path(chain):
    """Cheapest and then least string, by a search over whole paths in order of (cost, string)."""
    queue, best = [(0, "", 0, "")], None
    seen = set()
    while queue:
        cost, edits, at, roles = heapq.heappop(queue)
        if best is not None and (cost, edits) >= best:
            return best
        # What matters of the roles so far is whether they end on s, u or a, or are none.
        if at == len(chain) and GRAMMAR.fullmatch(roles):
            best = min(best or (cost, edits), (cost, edits))
            continue
        if len(roles) > len(chain) + 3 or not any(GRAMMAR.fullmatch(roles + x) for x in ("", "a", "ua")) or (at, roles, edits) in seen:
            continue
        seen.add((at, roles, edits))
        for x in "ua":
            heapq.heappush(queue, (cost + 5, edits + "I", at, roles + x))
        if at < len(chain):
            initial, fault = chain[at]
            heapq.heappush(queue, (cost + 2, edits + "D", at + 1, roles))
            if fault in (FINE, CUT):
                more = 5 * (fault == CUT)
                heapq.heappush(queue, (cost + more, edits + "K", at + 1, roles + initial))
                for x in "ua":
                    heapq.heappush(queue, (cost + 1 + more, edits + "R", at + 1, roles + x))
    return best


def test_every_short_chain():
    machine = Composition()
    symbols = [(r, f) for r in "sua-" for f in (FINE, CUT)] + [("u", BLANK), ("s", REPEATED)]
    for n in range(3):
        for chain in itertools.product(symbols, repeat=n):
            assert machine.shortest(list(chain)) == brute_path(chain), chain


def test_random_chains():
    machine, rng = Composition(), random.Random(0)
    for _ in range(150):
        chain = [(rng.choice("ssuuuaaa-"), rng.choice([FINE, FINE, FINE, CUT, BLANK, REPEATED])) for _ in range(rng.randint(3, 6))]
        assert machine.shortest(chain) == brute_path(chain), chain
    assert len(machine.positions) < 40
    long = [("u", FINE), ("a", FINE)] * 50_000
    assert machine.shortest(long) == (0, "K" * 100_000)


def plain(rows, ids):
    """All figures of op12, row by row."""
    out, machine = [], Composition()
    for conv in ids:
        mine = [(t, r or " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        chain, seen = [], set()
        for _, role, text in mine:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = BLANK if not last else REPEATED if (role, text) in seen else FINE if last[-1] in ".!?" else CUT
            seen.add((role, text))
            chain.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
        cost, audit = machine.shortest(chain)
        lines, at, roles = [], 0, ""
        for e in audit:
            role, text = ("", "") if e == "I" else mine[at][1:]
            at += e != "I"
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if roles[-1:] == "u" else "user"
            roles += role[0]
            lines.append(f"{role}:{text}")
        assert GRAMMAR.fullmatch(roles)
        turns = [t for t, *_ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        counts = [sum(f == k for _, f in chain) for k in (BLANK, REPEATED, CUT)]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (kind != 0) * (1 + (kind == 3))
    return out


def check(spark, frame):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    ids = {c for c, *_ in rows}
    expected = plain(damaged(rows), ids)
    found = [tuple(r) for r in digests(damage(frame), frame).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)
    return found


def test_real_table(spark):
    assert len(check(spark, spark.read.parquet(f"{SF}/conversations.parquet"))) == 20


def test_odd_rows(spark):
    rng = random.Random(1)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "u"], ["Yes.", "No", "", None, " \t\x0b", "Wait?\n", "é…", "a:b\nc.", "Yes."]
    rows = [(rng.choice([None, *range(25)]), rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts), 1, 2) for _ in range(400)]
    rows += [(77, None, "user", "again.", 0, 0)] * 300 + [(78, 3, "user", "w " * 300_000 + ".", 0, 0)] + [(None, k, ["user", "assistant"][k % 2], f"{k}.", 0, 0) for k in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    whole = check(spark, frame)
    assert sorted(map(tuple, digests(damage(frame.repartition(17)), frame).collect()), key=repr) == sorted(whole, key=repr)


def test_ids_of_text_and_nothing(spark):
    frame = spark.createDataFrame([("x", 0, "user", "Hi."), ("x", 1, "assistant", "Yes."), ("y", 0, "system", "Be.")], "conv_id string, turn int, role string, text string")
    found = {r.conv_id: (r.cost, r.audit) for r in audits(frame).collect()}
    assert found == {"x": (0, "KK"), "y": (2, "D")}
    empty = spark.createDataFrame([], SCHEMA)
    assert digests(damage(empty), empty).count() == 0 and repair(empty).count() == 0
    alone = digests(empty.select("conv_id", "turn", "role", "text"), spark.createDataFrame([(5,), (5,), (None,)], "conv_id long")).collect()
    assert sorted(map(tuple, alone), key=repr) == sorted([(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (5, None)], key=repr)


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "So."), (2, 0, "user", "A."), (2, 1, "assistant", "B."), (2, 2, "user", "C."), (2, 3, "user", "D!"), (3, 0, "tool", "")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = sorted(tuple(r) for r in repair(frame).collect())
    assert found == [(1, 0, "R", "user", "Hi."), (1, 1, "R", "assistant", "So."), (2, 0, "K", "user", "A."), (2, 1, "K", "assistant", "B."), (2, 2, "K", "user", "C."), (2, 3, "R", "assistant", "D!")]


@pytest.mark.parametrize("chain,cost,audit", [([], 0, ""), ([("u", FINE)], 2, "D"), ([("u", FINE), ("a", CUT)], 4, "DD"), ([("s", FINE), ("u", FINE)], 2, "RR")])
def test_known_costs(chain, cost, audit):
    assert Composition().shortest(chain) == brute_path(chain) == (cost, audit)
