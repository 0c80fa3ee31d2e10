"""Removal of globally repeated passages, with built-in DataFrame functions only.

A polynomial hash rolling over the hashes of WINDOW lines chooses where chunks end, so an insertion moves no boundary but
its neighbours; a long line, a paragraph that would show as several lines, is a chunk of its own. Chunks of two lines or
more, and long lines, that occur elsewhere too are compared byte by byte with their first occurrence, and equal ones grow
line by line, as far as the lines around them are equal too. What grows together is a passage, and goes if it has enough words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import discard, join_one, release_shuffles, salts_of, stage

KEY = "gridloom_key"
FOUND = "gridloom_found"
#: Lines under the rolling hash; its base and modulus (a prime, so products stay below 2**63).
WINDOW, BASE, PRIME = 2, 1_000_003, 2**31 - 1
#: Lines of so many characters are chunks of their own; no chunk has more lines than MOST.
LONG, MOST = 60, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once although body may use it for every element of an array."""
    return F.transform(F.array(value), body)[0]


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x09-\x0D ]+"), lambda w: w != ""))


def chunks(text: Column, mean_lines: int) -> Column:
    """The chunks of a text that are looked for elsewhere: array of (first, n, hash, low, high), lines counted from 0. From
    low to high a chunk may grow: from where the chunk before starts, less the lines for whose ends the rolling hash knows
    lines before them, to where the one after ends. Null for a null text."""
    number = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % PRIME
    is_long = lambda t, i: F.coalesce(F.length(F.get(t, i)) >= LONG, F.lit(False))

    def rolled(h: Column, i: Column) -> Column:
        value = F.lit(0).cast("long")
        for back in range(WINDOW, 0, -1):
            value = (value * BASE + F.coalesce(F.get(h, i - back), F.lit(0))) % PRIME
        return value

    def ends(t: Column, h: Column) -> Column:
        ended = lambda i: (i == F.size(t)) | is_long(t, i - 1) | is_long(t, i) | (rolled(h, i) % mean_lines == 0)
        return F.filter(F.sequence(F.lit(1), F.size(t)), ended)

    def cut(t: Column, e: Column) -> Column:
        start = lambda k: F.coalesce(F.get(e, k - 1), F.lit(0))
        part = lambda end: lambda s: F.struct(s.alias("first"), F.least(F.lit(MOST), end - s).alias("n"))
        whole = F.flatten(F.transform(e, lambda end, k: F.transform(F.sequence(start(k), end - 1, F.lit(MOST)), part(end))))
        return F.filter(whole, lambda c: (c["n"] >= 2) | is_long(t, c["first"]))

    def described(t: Column, found: Column) -> Column:
        return F.transform(
            found,
            lambda c, k: F.struct(
                c["first"].alias("first"),
                c["n"].alias("n"),
                F.xxhash64(F.slice(t, c["first"] + 1, c["n"])).alias("hash"),
                F.greatest(F.coalesce(F.get(found, k - 1)["first"], F.lit(0)) - (WINDOW - 1), F.lit(0)).alias("low"),
                F.coalesce(F.get(found, k + 1)["first"] + F.get(found, k + 1)["n"], F.size(t)).alias("high"),
            ),
        )

    return let(lines_of(text), lambda t: let(F.transform(t, number), lambda h: let(ends(t, h), lambda e: let(cut(t, e), lambda found: described(t, found)))))


def around(text: Column, found: Column) -> Column:
    """The chunks of `found` with the lines around them: from low to high for keepers; for others up to the next chunk of
    `found`, which is looked at itself."""

    def one(lines: Column, c: Column, k: Column) -> Column:
        own = lambda inner, outer: F.when(c["keeper"], outer).otherwise(inner)
        low = own(F.greatest(c["low"], F.coalesce(F.get(found, k - 1)["first"] + F.get(found, k - 1)["n"], F.lit(0))), c["low"])
        high = own(F.least(c["high"], F.coalesce(F.get(found, k + 1)["first"], c["high"])), c["high"])
        return F.struct(c["hash"].alias("hash"), c["keeper"].alias("keeper"), c["salts"].alias("salts"), c["first"].alias("first"), c["n"].alias("n"), (c["first"] - low).alias("at"), F.slice(lines, low + 1, high - low).alias("lines"))

    return let(lines_of(text), lambda lines: F.transform(found, lambda c, k: one(lines, c, k)))


def equal_from(many: Column, differ: Callable[[Column], Column]) -> Column:
    """How many of the places 0 to many - 1 come before the first that differs."""
    places = F.when(many > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return F.coalesce(F.array_min(F.filter(places, differ)), many)


def without(lines: Column, gone: Column) -> Column:
    """The lines joined, but for those of `gone`: runs (first, n) that don't overlap and are sorted."""
    end = lambda k: F.coalesce(F.get(gone, k - 1)["first"] + F.get(gone, k - 1)["n"], F.lit(0))
    begin = lambda k: F.coalesce(F.get(gone, k)["first"], F.size(lines))
    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, end(k) + 1, begin(k) - end(k)))), "\n")


def dedup_lines(docs: DataFrame, mean_lines: int = 2, min_words: int = 20, count_columns: bool = False) -> DataFrame:
    """docs with repeated passages removed from the texts; n_chars, if there, is counted anew.

    Chunks end after one line in mean_lines. Of all occurrences of a chunk, the one of least (doc_id, first line) stays, a null
    doc_id being the least of all, and so does each line that an occurrence has grown by: every line that goes has an equal
    line further up in this order, so none is lost from the whole. Runs of repeated lines of fewer than min_words words stay.

    Null and empty texts stay as they are; a text of which all lines go becomes
    empty; no row goes. Rows of the same doc_id and text count as one document and get the same result. With count_columns,
    n_lines and n_removed (lines) follow.

    Only hashes are grouped; texts are dealt by document. Joins on chunk hashes have one row a hash on one side, and are
    salted, so a chunk that a third of all documents share is dealt over tasks. Lines are copied once for 256 occurrences.
    """
    identity = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text"))
    # The length of the id tells where it ends, and whether there is one.
    named = docs.withColumn(KEY, F.unhex(F.md5(F.concat_ws("|", F.when(identity["unnamed"], "-").otherwise(F.length(identity["id"]).cast("string")), identity["id"], F.col("text")))))
    place = F.struct("doc_id", KEY, "first")
    seen = stage(
        named.select("doc_id", KEY, F.explode(chunks(F.col("text"), mean_lines)).alias("chunk")).select("doc_id", KEY, "chunk.*"),
        "chunks",
    )
    repeated = seen.groupBy("hash").agg(F.min(place).alias("keeper"), F.count("*").alias("many")).where("many > 1")
    repeated = repeated.select("hash", "keeper", salts_of(F.col("many")).alias("salts"))
    # By document: the chunks to look at. (The hash says which they may equal; the bytes decide.)
    entry = F.struct("first", "n", "low", "high", "hash", (place == F.col("keeper")).alias("keeper"), "salts")
    chosen = join_one(seen, repeated, ["hash"], by=[KEY, "first"]).groupBy(KEY).agg(F.sort_array(F.collect_set(entry)).alias(FOUND))
    looked_at = stage(
        named.select(KEY, "text").join(chosen, KEY).select(KEY, F.explode(around(F.col("text"), F.col(FOUND))).alias("x")).select(KEY, "x.*"),
        "repeated",
    )
    discard(seen)
    release_shuffles(docs.sparkSession)  # those of the texts among them, which are dealt once more below
    keepers = looked_at.where("keeper").groupBy("hash").agg(F.min(F.struct("at", "lines")).alias("kept"), F.first("salts").alias("salts"))
    pairs = join_one(looked_at.where("not keeper"), keepers, ["hash"], by=[KEY, "first"], salts="salts")
    own, kept = F.col("lines"), F.col("kept.lines")
    at, kept_at, n = F.col("at"), F.col("kept.at"), F.col("n")
    back = equal_from(F.least(at, kept_at), lambda i: F.get(own, at - 1 - i) != F.get(kept, kept_at - 1 - i))
    on = equal_from(F.least(F.size(own) - at - n, F.size(kept) - kept_at - n), lambda i: F.get(own, at + n + i) != F.get(kept, kept_at + n + i))
    same = F.slice(own, at + 1, n) == F.slice(kept, kept_at + 1, n)
    grown = pairs.where(same).select(KEY, (F.col("first") - back).alias("begin"), (F.col("first") + n + on).alias("end"))
    order = Window.partitionBy(KEY).orderBy("begin", "end")
    apart = F.col("begin") > F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = grown.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(KEY, "run").agg(F.min("begin").alias("first"), (F.max("end") - F.min("begin")).alias("n"))
    gone = stage(runs.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias(FOUND)), "gone")
    discard(looked_at)
    release_shuffles(docs.sparkSession)
    result = named.join(gone, KEY, "left")

    def enough(lines: Column) -> Column:
        words = lambda c: words_in(F.array_join(F.slice(lines, c["first"] + 1, c["n"]), "\n"))
        return F.filter(FOUND, lambda c: words(c) >= min_words)

    cut = let(lines_of(F.col("text")), lambda lines: let(enough(lines), lambda g: F.struct(without(lines, g).alias("text"), F.size(g).alias("runs"), F.aggregate(g, F.lit(0), lambda a, c: a + c["n"]).alias("n"))))
    result = result.withColumn(FOUND, F.when(F.col(FOUND).isNotNull(), cut))
    whole = F.coalesce(F.col(f"{FOUND}.runs"), F.lit(0)) == 0
    text = F.when(whole, F.col("text")).otherwise(F.col(f"{FOUND}.text"))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(whole, F.col("n_chars")).otherwise(F.char_length(text).cast(docs.schema["n_chars"].dataType))
    columns = [changed.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns]
    if count_columns:
        columns += [
            F.when(F.col("text").isNull(), 0).otherwise(F.size(lines_of(F.col("text")))).cast("long").alias("n_lines"),
            F.coalesce(F.col(f"{FOUND}.n"), F.lit(0)).cast("long").alias("n_removed"),
        ]
    return result.select(*columns)


#: The rows of op2_line_dedup (with its defaults) in DuckDB; doc_ids are unique there.
ORACLE = f"""
WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
x AS (SELECT doc_id, CAST(unnest(range(1, len(raw) + 1)) AS BIGINT) - 1 AS i, unnest(raw) AS x FROM t),
h AS (SELECT *, CAST('0x' || substr(md5(x), 1, 8) AS BIGINT) % {PRIME} AS h, length(x) >= {LONG} AS long FROM x),
e AS (SELECT *, CAST(lead(i) OVER w IS NULL OR long OR coalesce(lead(long) OVER w, FALSE) OR ((coalesce(lag(h) OVER w, 0) * {BASE} + h) % {PRIME}) % 2 = 0 AS INT) AS ends
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM e),
d AS (SELECT *, (i - min(i) OVER (PARTITION BY doc_id, c)) // {MOST} AS part FROM c),
k AS (SELECT doc_id, min(i) AS first, count(*) AS n, string_agg(x, chr(1) ORDER BY i) AS body, bool_or(long) AS long FROM d GROUP BY doc_id, c, part),
s AS (SELECT *, row_number() OVER (PARTITION BY body, n ORDER BY doc_id, first) AS k, count(*) OVER (PARTITION BY body, n) AS many,
  greatest(coalesce(lag(first) OVER w, 0) - {WINDOW - 1}, 0) AS low, coalesce(lead(first + n) OVER w, 1000000000) AS high FROM k WHERE n >= 2 OR long WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
r AS (SELECT *, greatest(low, coalesce(lag(first + n) OVER w, 0)) AS own_low, least(high, coalesce(lead(first) OVER w, high)) AS own_high FROM s WHERE many > 1 WINDOW w AS (PARTITION BY doc_id ORDER BY first)),
o AS (SELECT row_number() OVER () AS o, a.doc_id, a.first, a.n, a.own_low, a.own_high, b.doc_id AS kept, b.first AS kept_first, b.low AS kept_low, b.high AS kept_high
  FROM r a JOIN r b ON a.body = b.body AND a.n = b.n AND b.k = 1 WHERE a.k > 1),
b AS (SELECT o, coalesce(max(a.i) FILTER (WHERE a.x <> b.x) + 1, min(a.i)) AS begin FROM o JOIN x a ON a.doc_id = o.doc_id AND a.i >= own_low AND a.i < first
  JOIN x b ON b.doc_id = kept AND b.i = a.i - first + kept_first AND b.i >= kept_low GROUP BY o),
f AS (SELECT o, coalesce(min(a.i) FILTER (WHERE a.x <> b.x), max(a.i) + 1) AS until FROM o JOIN x a ON a.doc_id = o.doc_id AND a.i >= first + n AND a.i < own_high
  JOIN x b ON b.doc_id = kept AND b.i = a.i - first + kept_first AND b.i < kept_high GROUP BY o),
g AS (SELECT DISTINCT doc_id, unnest(range(coalesce(begin, first), coalesce(until, first + n))) AS i FROM o LEFT JOIN b USING (o) LEFT JOIN f USING (o)),
m AS (SELECT x.doc_id, x.i, x.x, g.i IS NOT NULL AS gone FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.i = x.i),
v AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, gone ORDER BY i) AS run FROM m),
q AS (SELECT doc_id, gone, run, min(i) AS first, count(*) AS n, string_agg(x, chr(10) ORDER BY i) AS body FROM v GROUP BY ALL),
z AS (SELECT doc_id, first, n, body, gone AND len(list_filter(string_split_regex(body, '[\\x09-\\x0D ]+'), lambda w: w <> '')) >= 20 AS gone FROM q),
a AS (SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY first) FILTER (WHERE NOT gone), '') AS text, sum(n) AS n_lines, coalesce(sum(n) FILTER (WHERE gone), 0) AS n_removed FROM z GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE a.text END AS text, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN a USING (doc_id)
"""
