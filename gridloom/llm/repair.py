"""Repair of a conversation's structure by weighted finite-state composition.

Three machines meet: the conversation as a chain of symbols (initial of the role, fault of the row), an edit transducer (keep, change the
role, delete, insert), and an acceptor of the roles' grammar (s?(ua)+)?. Their composition is never built: arcs are made for the states
that a chain reaches, and kept for the next chain. Weights are pairs (cost, string of edits), least first. The best way on from each
state is found from the end of the chain to its start, a topological order, as strings can only be compared by their first difference:
no two arcs of a state have the same label, so that is the label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.window import Window

from gridloom.llm.common import stage

SPACE = "\t\n\x0b\f\r "
#: The role grammar: from each state, the initials that lead on. States 0 and 3 are final.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
#: Costs: keep, change the role, delete, insert, and what a truncated row costs that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Faults of a row, by what comes first.
FINE, BLANK, REPEATED, CUT = range(4)

Arc = tuple[int, str, int]


def arcs(symbol: tuple[str, int], state: int) -> Iterator[Arc]:
    """(cost, label, grammar state behind it) of the arcs of the composition that use up a symbol."""
    initial, fault = symbol
    yield DELETE, "D", state
    if fault in (BLANK, REPEATED):
        return
    more = TRUNCATED if fault == CUT else 0
    if initial in GRAMMAR[state]:
        yield KEEP + more, "K", GRAMMAR[state][initial]
    for to in ROLES.keys() & GRAMMAR[state].keys():
        yield REROLE + more, "R", GRAMMAR[state][to]


def inserts(state: int) -> Iterator[Arc]:
    for to in ROLES.keys() & GRAMMAR[state].keys():
        yield INSERT, "I", GRAMMAR[state][to]


class Composition:
    """The composed machine as far as it has been needed: a position of a chain is (costs from each grammar state to the end, less the
    least of them), of which there are few; a symbol before it leads to another, and fixes each state's best arc."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[int, ...], int] = {}
        self.positions: list[tuple[int, ...]] = []
        self.steps: dict[tuple[int, tuple[str, int]], tuple[int, int, tuple[Arc, ...]]] = {}
        ends = [(0, "", g) if g in FINAL else None for g in range(len(GRAMMAR))]
        self.end = self.settle(ends)

    def settle(self, best: list[Arc | None]) -> tuple[int, int, tuple[Arc, ...]]:
        """Best arcs with inserts, given those without: the position's number, the least cost, and the arcs."""
        changed = True
        while changed:
            changed = False
            for g in range(len(GRAMMAR)):
                for cost, label, to in inserts(g):
                    if best[to] is not None and (best[g] is None or (cost + best[to][0], label) < best[g][:2]):
                        best[g], changed = (cost + best[to][0], label, to), True
        least = min(cost for cost, _, _ in best)
        costs = tuple(cost - least for cost, _, _ in best)
        if costs not in self.numbers:
            self.numbers[costs] = len(self.positions)
            self.positions.append(costs)
        return self.numbers[costs], least, tuple(best)

    def before(self, position: int, symbol: tuple[str, int]) -> tuple[int, int, tuple[Arc, ...]]:
        """The position before a symbol that leads to this one."""
        if (found := self.steps.get((position, symbol))) is None:
            costs = self.positions[position]
            best = [min((cost + costs[to], label, to) for cost, label, to in arcs(symbol, g)) for g in range(len(GRAMMAR))]
            found = self.steps[position, symbol] = self.settle(best)
        return found

    def shortest(self, chain: list[tuple[str, int]]) -> tuple[int, str]:
        """Cost and edits of the best path."""
        at, total, _ = self.end
        path = [self.end[2]]
        for symbol in reversed(chain):
            at, least, best = self.before(at, symbol)
            total += least
            path.append(best)
        state, out = 0, []
        cost = total + self.positions[at][state]
        while path:
            _, label, to = path[-1][state]
            out.append(label)
            state = to
            if label != "I":
                path.pop()
        return cost, "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) as they might have come from a broken export, by crc32 of `conv_id:turn` modulo 20: rows
    of 0 are missing, of 1 have no text, of 2 none of .!?, those of 3 are there twice, those of 4 have the role user. Nulls count as
    one space, but conv_id and turn stay null."""
    space = F.lit(" ")
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), space)
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20).alias("gridloom_kind"))
    kind = F.col("gridloom_kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(kind == 4, "user").otherwise(F.col("role"))
    rows = rows.where(kind != 0).withColumn("gridloom_copy", F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def _marked(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, nulls of the last two as one space; digest of the text; in the order (turn, role, digest), nulls
    first, each conversation is read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(conversations: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """Per conversation: gaps (turns missing between the first and the last), rows that are blank, duplicate or truncated (the first of
    these that holds), illegal (adjacent roles that the grammar doesn't have), cost and audit (the cheapest edits in order: Keep, Rerole,
    Delete, Insert; of equally cheap ones the least string). Also for those that only conv_ids has: zeros and an empty audit.

    Texts aren't moved, only their digests. Rows that are equal are added up first, and whether a content was seen earlier is found per
    content, so a conversation with a share of all rows is only brought together as one symbol a row, in the one string that it becomes."""
    rows = _marked(conversations)
    trimmed = F.expr(f"rtrim('{''.join(f'\\u{ord(c):04x}' for c in SPACE)}', text)")
    rows = rows.withColumn("trimmed", trimmed).select(
        "conv_id", "turn", "role", "digest", F.lit(True).alias("there"), F.when(F.col("trimmed") == "", BLANK).when(F.substring("trimmed", -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT).alias("fault")
    )
    ids = conversations.select("conv_id") if conv_ids is None else conversations.select("conv_id").unionAll(conv_ids.select("conv_id"))
    none = F.lit(None)
    rows = rows.unionAll(ids.select("conv_id", none.cast("long"), none.cast("string"), none.cast("string"), F.lit(False), F.lit(FINE)))
    counted = rows.groupBy("conv_id", "there", "turn", "role", "digest", "fault").agg(F.count("*").alias("n"))
    # Null turns first, as in the order of reading.
    seen = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    counted = counted.withColumn("seen", seen).withColumn("initial", F.substring("role", 1, 1))
    counted = counted.repartition("conv_id").sortWithinPartitions("conv_id", "there", F.asc_nulls_first("turn"), "role", "digest").select("conv_id", "there", "turn", "initial", "fault", "seen", "n")
    schema = StructType([conversations.schema["conv_id"]])
    for name in FIGURES:
        schema = schema.add(name, LongType())
    schema = schema.add("audit", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Composition()
        ids: pa.DataType | None = None
        done: list[tuple] = []
        chain: list[tuple[str, int]] = []
        turns: list[int] = []  # first, last and number of distinct ones
        current: object = None
        begun = False

        def finish() -> None:
            counts = [sum(f == k for _, f in chain) for k in (BLANK, REPEATED, CUT)]
            illegal = sum(a[0] + b[0] not in LEGAL for a, b in zip(chain, chain[1:], strict=False))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((current, gaps, *counts, illegal, *machine.shortest(chain)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            arrays = [pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:-1]), pa.array(columns[-1], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            for conv, there, turn, initial, fault, seen, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or conv != current:
                    if begun:
                        finish()
                    chain, turns, current, begun = [], [], conv, True
                if not there:
                    continue
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
                first = (initial if initial in ("s", "u", "a") else "-", fault if fault == BLANK else REPEATED if seen else fault)
                chain.append(first)
                if n > 1:
                    chain += [(first[0], BLANK if fault == BLANK else REPEATED)] * (n - 1)
            if len(done) >= 10_000:
                yield flush()
        if begun:
            finish()
            yield flush()

    return counted.mapInArrow(run, schema)


def _replay(conversations: DataFrame, found: DataFrame, schema: StructType, consumer: Callable) -> DataFrame:
    """Each conversation's audit and then its rows, in order, through a consumer in one pass: texts are moved once and none is kept."""
    rows = _marked(conversations)
    missing = [F.lit(None).cast("long").alias(c) for c in FIGURES]
    both = rows.select("conv_id", F.lit(1).alias("part"), "turn", "role", "digest", "text", *missing).unionAll(
        found.select("conv_id", F.lit(0), F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), "audit", *FIGURES)
    )
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest").drop("digest", "turn")
    return ordered.mapInArrow(consumer, schema)


def _edited(batch: pa.RecordBatch, state: dict) -> Iterator[tuple]:
    """(conv_id, edit, role, text) of each row that stays, and (conv_id, None, audit, figures) before a conversation's first. `state` is
    carried from batch to batch; its owner calls _inserted() after the last."""
    for conv, part, role, text, *figures in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if part == 0:
            yield from _inserted(state)
            state.update(conv=conv, audit=text, at=0, grammar=0)
            yield conv, None, text, figures
            continue
        yield from _inserted(state)
        edit = state["audit"][state["at"]]
        state["at"] += 1
        if edit == "D":
            continue
        if edit == "R":
            role = next(ROLES[k] for k in GRAMMAR[state["grammar"]] if k in ROLES)
        state["grammar"] = GRAMMAR[state["grammar"]][role[0]]
        yield conv, edit, role, text


def _inserted(state: dict) -> Iterator[tuple]:
    """The rows that the audit inserts where it stands."""
    while state and state["audit"][state["at"] : state["at"] + 1] == "I":
        state["at"] += 1
        initial = next(k for k in GRAMMAR[state["grammar"]] if k in ROLES)
        state["grammar"] = GRAMMAR[state["grammar"]][initial]
        yield state["conv"], "I", ROLES[initial], ""


def repair(conversations: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), edit (K, R or I), role and text. `found` is what audits() gave for them.

    Rows are read in the order of turn, nulls first, then role, then the text's digest; nulls of role and text count as one space, a role of no
    character is none that can be kept. A null conv_id is a conversation; rows that repeat whole are duplicates; other columns are
    ignored; of a conversation of which nothing stays there are no rows, and an empty table gives none."""
    found = stage(audits(conversations), "repair-audits") if found is None else found
    schema = StructType([conversations.schema["conv_id"]]).add("place", LongType()).add("edit", StringType()).add("role", StringType()).add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        place, ids = 0, None

        def out(events: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal place
            rows = []
            for conv, edit, role, text in events:
                if edit is None:
                    place = 0
                    continue
                rows.append((conv, place, edit, role, text))
                place += 1
            if rows:
                columns = list(zip(*rows, strict=True))
                kinds = (ids, pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=schema.names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            yield from out(_edited(batch, state))
        yield from out(_inserted(state))

    return _replay(conversations, found, schema, run)


def digests(conversations: DataFrame, conv_ids: DataFrame | None = None) -> DataFrame:
    """What audits() gives, and repaired_sha256: of the repaired rows as `role:text`, joined by line feeds, hashed as they pass."""
    found = stage(audits(conversations, conv_ids), "repair-audits")
    schema = StructType([*found.schema.fields]).add("repaired_sha256", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}
        ids = None
        done: list[list] = []
        hasher, lines = hashlib.sha256(), 0

        def take(events: Iterator[tuple]) -> None:
            nonlocal hasher, lines
            for conv, edit, role, text in events:
                if edit is None:
                    if done:
                        done[-1].append(hasher.hexdigest())
                    hasher, lines = hashlib.sha256(), 0
                    done.append([conv, *text, role])
                    continue
                hasher.update((b"\n" if lines else b"") + f"{role}:{text}".encode())
                lines += 1

        def flush(rows: list[list]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            arrays = [pa.array(columns[0], ids), *(pa.array(c, pa.int64()) for c in columns[1:-2]), *(pa.array(c, pa.string()) for c in columns[-2:])]
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            ids = batch.schema.field("conv_id").type
            take(_edited(batch, state))
            if len(done) > 10_000:
                yield flush(done[:-1])
                del done[:-1]
        take(_inserted(state))
        if done:
            done[-1].append(hasher.hexdigest())
            yield flush(done)

    return _replay(conversations, found, schema, run)


_TABLE = "list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
#: crc32 of an ASCII string k.
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(k) + 1), lambda i: CAST(ord(k[i]) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"


def _options(g: int) -> str:
    """SQL for the least [cost, audit] from grammar state g: over the arcs that use up the row, and an insert before the best of those."""
    return "list_sort([" + ", ".join(f"{{'c': {c}, 'a': {a}}}" for c, a in _arcs_sql(g)) + "])[1]"


def _arcs_sql(g: int) -> list[tuple[str, str]]:
    gone = f"fault IN ({BLANK}, {REPEATED})"
    more = f"CASE WHEN {gone} THEN 1000000000 WHEN fault = {CUT} THEN {TRUNCATED} ELSE 0 END"
    out = [(f"{DELETE} + v{g}.c", f"'D' || v{g}.a")]
    for initial, to in GRAMMAR[g].items():
        out.append((f"CASE WHEN initial = '{initial}' THEN {KEEP} + {more} ELSE 1000000000 END + v{to}.c", f"'K' || v{to}.a"))
        if initial in ROLES:
            out.append((f"{REROLE} + {more} + v{to}.c", f"'R' || v{to}.a"))
    return out


_INSERT = lambda to, more: f"list_sort([b{{g}}, {{{{'c': {INSERT} + b{to}.c, 'a': 'I' || b{to}.a}}}}{more}])[1]"
_SETTLED = {
    2: _INSERT(3, ""),
    3: _INSERT(2, ""),
    0: _INSERT(2, f", {{{{'c': {2 * INSERT} + b3.c, 'a': 'II' || b3.a}}}}"),
    1: _INSERT(2, f", {{{{'c': {2 * INSERT} + b3.c, 'a': 'II' || b3.a}}}}"),
}
_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"

ORACLE = f"""
WITH RECURSIVE t AS (SELECT {_TABLE} AS tab),
r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
r1 AS (SELECT r0.*, {CRC} % 20 AS kind FROM r0, t),
r2 AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM r1 WHERE kind <> 0),
r3 AS (SELECT *, rtrim(text, {_SPACES}) AS trimmed, left(role, 1) AS initial, dense_rank() OVER (ORDER BY conv_id NULLS LAST) AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM r2),
r4 AS (SELECT *, CASE WHEN trimmed = '' THEN {BLANK} WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN {REPEATED} WHEN right(trimmed, 1) IN ('.', '!', '?') THEN {FINE} ELSE {CUT} END AS fault,
  lag(initial) OVER (PARTITION BY conv ORDER BY i) AS last FROM r3),
n AS (SELECT conv, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = {BLANK}) AS blank, count(*) FILTER (WHERE fault = {REPEATED}) AS duplicate,
  count(*) FILTER (WHERE fault = {CUT}) AS truncated, count(*) FILTER (WHERE last || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r4 GROUP BY conv),
f AS (SELECT conv, n AS i, {{'c': 0, 'a': ''}} AS v0, {{'c': {2 * INSERT}, 'a': 'II'}} AS v1, {{'c': {INSERT}, 'a': 'I'}} AS v2, {{'c': 0, 'a': ''}} AS v3 FROM n
  UNION ALL SELECT conv, i - 1, {", ".join(_SETTLED[g].format(g=g) for g in range(4))} FROM (SELECT f.conv, f.i, {", ".join(f"{_options(g)} AS b{g}" for g in range(4))} FROM f JOIN r4 ON r4.conv = f.conv AND r4.i = f.i)),
best AS (SELECT conv, v0.c AS cost, v0.a AS audit FROM f WHERE i = 0),
e AS (SELECT conv, p, substr(audit, p, 1) AS edit, p - len(replace(left(audit, p), 'I', '')) AS n_inserted, len(replace(left(audit, p), 'D', '')) AS spot FROM (SELECT conv, audit, unnest(range(1, len(audit) + 1)) AS p FROM best)),
k AS (SELECT e.*, r4.role, r4.text FROM e LEFT JOIN r4 ON r4.conv = e.conv AND r4.i = e.p - e.n_inserted AND edit <> 'I' WHERE edit <> 'D'),
s AS (SELECT conv, max(CASE WHEN spot = 1 AND edit = 'K' AND left(role, 1) = 's' THEN 1 ELSE 0 END) AS led FROM k GROUP BY conv),
o AS (SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (spot - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY spot) AS whole FROM k JOIN s USING (conv) GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best USING (conv) LEFT JOIN o USING (conv)
"""
