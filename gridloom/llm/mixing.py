"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets share the corpus' words by weight, none above a multiple of its source's words. The whole passes over a source that its target
holds are taken as they are. For the rest, blocks of equal length are apportioned to sources by highest quotients rest / (2 k - 1), then
from each source to its regions and from each region to its shards by their words. A shard lays its documents end to end in seeded
order and takes as many blocks as its quota, those of least seeded hash. So every shard is chosen from alone, and no order of the
corpus is ever formed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import any_type, join_one, stage

WORD = "[^\\x20\\x09-\\x0D]+"
#: Words of a block, and passes over a document at most.
BLOCK, PASSES = 32, 3
#: A shard has about so many words, and documents, at most; a region so many shards. They bound what one task holds.
SHARD_WORDS, SHARD_ROWS, REGION = 1 << 17, 1 << 12, 1 << 10
#: So many equal rows stay together.
COPIES = 1 << 10
#: The table of sources is broadcast up to so many rows; beyond, it is joined with salts.
FEW_SOURCES = 100_000


def weights_in_turn(place: Column) -> Column:
    """1, 2, 3, repeating, by the source's place (from 1) in the order of code points, null last."""
    return (place - 1) % 3 + 1


def targets(sources: DataFrame, weight: Column | None = None, passes: int = PASSES) -> DataFrame:
    """sources (source, words) with place, weight and target. The targets add up to all words and are in proportion to the weights
    where they are below passes * words. `weight` is a column over place and source, positive. One row a source, ordered in one task."""
    everything = Window.partitionBy(F.lit(0))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))).cast("long"))
    placed = placed.withColumn("weight", weights_in_turn(F.col("place")) if weight is None else weight).withColumn("cap", passes * F.col("words"))
    # In this order the sources that are held at their cap come first.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("words") / F.col("weight"), "place")
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    since = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    share = (F.sum("words").over(everything) - before) * F.col("weight") / since
    held = placed.withColumn("held", F.col("cap") < share)
    left = F.sum("words").over(everything) - F.coalesce(F.sum(F.when(F.col("held"), F.col("cap"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("held"), F.col("weight"))).over(everything)
    target = F.when(F.col("held"), F.col("cap").cast("double")).otherwise(left * F.col("weight") / free)
    return held.withColumn("target", target).drop("cap", "held")


def apportion(cells: DataFrame, within: list[str], cell: str, weight: str, seats: str, name: str) -> DataFrame:
    """cells with a further column: of the `seats` of the group that the columns `within` name, those that go to the cell by highest
    quotients weight / (2 k - 1); ties go to the smaller cell. Weights aren't negative; seats are the same in all rows of a group.

    Cells get at once what is theirs at a quotient so high that not all seats are given, and only the seats between that and one so low that
    enough are given are ranked: at most three for each cell, however many seats there are."""
    group = Window.partitionBy(*(within or [F.lit(0)]))
    total, n, w, s = F.sum(weight).over(group), F.count("*").over(group), F.col(weight), F.col(seats)
    upto = lambda double_seats, slack: F.coalesce(F.floor((F.try_divide(w * double_seats, F.col("gridloom_total")) * slack + 1) / 2), F.lit(0))
    rows = cells.withColumn("gridloom_total", total.cast("double")).withColumn("gridloom_n", n)
    rows = rows.withColumn("gridloom_base", F.when(2 * s > F.col("gridloom_n"), upto(2 * s - F.col("gridloom_n"), 1 - 1e-9)).otherwise(0).cast("long"))
    most = F.greatest(F.col("gridloom_base"), upto(2 * s + F.col("gridloom_n"), 1 + 1e-9)).cast("long") + 1
    rows = rows.withColumn("gridloom_open", s - F.sum("gridloom_base").over(group))
    asked = rows.withColumn("gridloom_seat", F.explode(F.sequence(F.col("gridloom_base") + 1, most)))
    rank = F.row_number().over(group.orderBy(F.desc(w / (2 * F.col("gridloom_seat") - 1)), F.asc(cell)))
    won = F.count_if((F.col("gridloom_rank") <= F.col("gridloom_open")) & (w > 0))
    ranked = asked.withColumn("gridloom_rank", rank)
    return ranked.groupBy(*cells.columns, "gridloom_base").agg(won.alias("gridloom_won")).select(*cells.columns, (F.col("gridloom_base") + F.col("gridloom_won")).alias(name))


def seeded(seed: int, *parts: Column) -> Column:
    """60 bits of the MD5 of the seed and the parts, as decimal text joined by colons; null counts as empty."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def chosen_blocks(words: int, quota: int, label: str, block: int = BLOCK) -> np.ndarray:
    """A flag for each of a shard's blocks: `quota` of them are chosen, by their hash with the label. The last block, if it is short,
    is only chosen with all others."""
    full = words // block
    picked = np.zeros(-(-words // block), bool)
    if quota >= len(picked):
        picked[:] = True
    elif quota:
        order = np.array([int(hashlib.md5(f"{label}:{k}".encode()).hexdigest()[:15], 16) for k in range(full)], np.int64)
        picked[np.lexsort((np.arange(full), order))[:quota]] = True
    return picked


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 42, block: int = BLOCK, passes: int = PASSES) -> DataFrame:
    """What the mix takes of each document (doc_id, source, text): doc_id, source, size (its words), source_size, target (its
    source's words in the mix, a double), passes (how often it is taken whole), spans (first word and the word after the last of what is
    taken once more), and taken (words, repeats counted). One row a document; other columns are ignored.

    A null text has no words, a null source is a source. Equal rows count apart and share what falls to them; reruns agree, whatever the
    partitioning. Long documents may be cut by blocks. Empty tables give no rows; sources without words have the target 0.

    Texts are read once. After that only ids, sources and sizes move; a group holds a shard, whatever the source's share of the corpus."""
    sizes = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    copies = sizes.groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows"))
    starts = F.explode(F.sequence(F.lit(0), F.col("rows") - 1, F.lit(COPIES)))
    copies = stage(copies.withColumn("at", starts).withColumn("copies", F.least(F.col("rows") - F.col("at"), F.lit(COPIES))).drop("rows"), "mix-sizes")

    sources = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), F.sum("copies").alias("rows"))
    sources = targets(sources, weight, passes).withColumn("passes", F.coalesce(F.floor(F.try_divide("target", "words")), F.lit(0)).cast("int"))
    sources = sources.withColumn("rest", F.col("target") - F.col("passes") * F.col("words"))
    seats = F.floor(F.sum("rest").over(Window.partitionBy(F.lit(0))) / block + 0.5)
    sources = apportion(sources.withColumn("seats", seats), [], "place", "rest", "seats", "quota").drop("seats")
    shards = F.ceil(F.greatest(F.col("words") / SHARD_WORDS, F.col("rows") / SHARD_ROWS)).cast("long")
    sources = stage(sources.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).withColumn("shards", shards), "mix-sources")

    known = sources.select("name", "place", "shards")
    rows = copies.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    if sources.count() <= FEW_SOURCES:
        rows = rows.join(F.broadcast(known), "name")  # at most FEW_SOURCES rows
    else:
        rows = join_one(rows, known, ["name"], ["doc_id", "size", "at"])
    key = seeded(seed, F.col("doc_id"), F.col("size"), F.col("at"))
    rows = rows.drop("name", "source").withColumn("key", key).withColumn("shard", F.col("key") % F.col("shards")).drop("shards")

    held = rows.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("held")).withColumn("region", F.floor(F.col("shard") / REGION))
    regions = held.groupBy("place", "region").agg(F.sum("held").alias("held")).join(sources.select("place", F.col("quota").alias("seats")), "place")
    regions = apportion(regions, ["place"], "region", "held", "seats", "quota").select("place", "region", F.col("quota").alias("seats"))
    quotas = apportion(held.join(regions, ["place", "region"]), ["place", "region"], "shard", "held", "seats", "quota")
    quotas = quotas.join(sources.select("place", "source", F.col("words").alias("source_size"), "target", "passes"), "place")
    quotas = quotas.select(F.col("place").alias("its_place"), F.col("shard").alias("its_shard"), "source", "source_size", "target", "passes", F.col("shard").alias("number"), "quota")

    kind = any_type(docs)
    schema = f"doc_id {kind}, source string, size long, source_size long, target double, passes int, spans array<struct<start:long,end:long>>, taken long"

    def take(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("key", "ascending"), ("size", "ascending"), ("at", "ascending")])
        n = left.column("copies").to_numpy()
        row = np.repeat(np.arange(len(left)), n)
        size = left.column("size").to_numpy()[row]
        ends = np.cumsum(size)
        one = {c: right.column(c)[0].as_py() for c in right.column_names}
        words = int(ends[-1])
        whole = one["passes"]
        picked = chosen_blocks(words, one["quota"], f"{seed}:{one['source'] or ''}:{one['number']}", block)
        edge = np.flatnonzero(np.diff(picked.astype(np.int8), prepend=0, append=0))
        first, last = edge[::2] * block, np.minimum(edge[1::2] * block, words)
        # The runs of chosen blocks that a document meets, cut to it.
        begins = ends - size
        low, high = np.searchsorted(last, begins, "right"), np.searchsorted(first, ends, "left")
        met = np.where(size > 0, np.maximum(high - low, 0), 0)
        offsets = np.concatenate([[0], np.cumsum(met)])
        run = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - low, met)
        a = np.maximum(first[run], np.repeat(begins, met)) - np.repeat(begins, met)
        b = np.minimum(last[run], np.repeat(ends, met)) - np.repeat(begins, met)
        extra = np.concatenate([[0], np.cumsum(b - a)])
        spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["start", "end"]))
        same = lambda c, t: pa.array([one[c]] * len(row), t)
        return pa.table(
            {
                "doc_id": left.column("doc_id").take(pa.array(row)), "source": same("source", pa.string()), "size": pa.array(size, pa.int64()),
                "source_size": same("source_size", pa.int64()), "target": same("target", pa.float64()), "passes": pa.array(np.full(len(row), whole), pa.int32()),
                "spans": spans, "taken": pa.array(whole * size + extra[offsets[1:]] - extra[offsets[:-1]], pa.int64()),
            }
        )

    return rows.groupBy("place", "shard").cogroup(quotas.groupBy("its_place", "its_shard")).applyInArrow(take, schema)


def passages(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself: doc_id and text for each whole pass over a document and each span of it, words joined by one space. Ids must be
    unique and not null; other documents are not found."""
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), F.lit(1))
    parts = F.concat(F.array_repeat(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end")), F.col("passes")), "spans")
    rows = docs.select("doc_id", "text").join(mixed.where("taken > 0").select("doc_id", parts.alias("parts")), "doc_id").select("doc_id", words.alias("words"), "parts")
    cut = rows.select("doc_id", "words", F.explode("parts").alias("part"))
    length = (F.col("part.end") - F.col("part.start")).cast("int")
    return cut.select("doc_id", F.array_join(F.slice("words", (F.col("part.start") + 1).cast("int"), length), " ").alias("text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS words, count(*) AS n, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, (place - 1) % 3 + 1 AS w, {PASSES} * words AS cap, sum(words) OVER () AS total FROM s0),
s2 AS (SELECT *, cap < CAST((total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS DOUBLE) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS capped
  FROM s1 WINDOW o AS (ORDER BY words / w, place)),
s3 AS (SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST((total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) * w AS DOUBLE) / sum(w) FILTER (WHERE NOT capped) OVER () END AS target,
  CAST(ceil(greatest(words / {SHARD_WORDS}, n / {SHARD_ROWS})) AS BIGINT) AS shards FROM s2),
s4 AS (SELECT place, target, CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END AS whole, target - CASE WHEN words > 0 THEN CAST(floor(target / words) AS BIGINT) ELSE 0 END * words AS rest FROM s3),
s5 AS (SELECT *, CAST(floor((SELECT sum(rest) FROM s4) / {BLOCK} + 0.5) AS BIGINT) AS seats FROM s4),
q AS (SELECT place, count(*) AS quota FROM (SELECT place, row_number() OVER (ORDER BY rest / (2 * k - 1) DESC, place) AS rank, seats FROM (SELECT place, rest, seats, unnest(range(1, seats + 1)) AS k FROM s5 WHERE rest > 0)) WHERE rank <= seats GROUP BY place),
k AS (SELECT d.*, s3.place, CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size || ':0'), 1, 15) AS BIGINT) AS key, shards FROM d JOIN s3 ON d.source IS NOT DISTINCT FROM s3.source),
l AS (SELECT place, key % shards AS shard, sum(size)::BIGINT AS held FROM k GROUP BY ALL),
lq AS (SELECT place, shard, count(*) AS quota FROM (SELECT place, shard, quota, row_number() OVER (PARTITION BY place ORDER BY held / (2 * j - 1) DESC, shard) AS rank FROM (SELECT l.*, quota, unnest(range(1, quota + 1)) AS j FROM l JOIN q USING (place) WHERE held > 0)) WHERE rank <= quota GROUP BY 1, 2),
g AS (SELECT l.place, l.shard, held, s4.whole, coalesce(quota, 0) AS wanted FROM l JOIN s4 USING (place) LEFT JOIN lq ON lq.place = l.place AND lq.shard = l.shard),
b AS (SELECT place, shard, j, wanted FROM (SELECT g.*, unnest(range(0, (held + {BLOCK - 1}) // {BLOCK})) AS j FROM g)),
c AS (SELECT place, shard, j FROM (SELECT b.*, row_number() OVER (PARTITION BY b.place, shard ORDER BY (j + 1) * {BLOCK} > held, CAST('0x' || substr(md5('42:' || coalesce(source, '') || ':' || shard || ':' || j), 1, 15) AS BIGINT), j) AS rank
  FROM b JOIN l USING (place, shard) JOIN s3 ON s3.place = b.place) WHERE rank <= wanted),
p AS (SELECT doc_id, size, place, key % shards AS shard, row_number() OVER (PARTITION BY place, key % shards ORDER BY key, size) AS row, sum(size) OVER (PARTITION BY place, key % shards ORDER BY key, size ROWS UNBOUNDED PRECEDING) AS until FROM k),
x AS (SELECT place, shard, row, sum(least(until, (j + 1) * {BLOCK}) - greatest(until - size, j * {BLOCK})) AS extra FROM p JOIN c USING (place, shard) WHERE until > j * {BLOCK} AND until - size < (j + 1) * {BLOCK} GROUP BY ALL)
SELECT p.doc_id, p.size, s3.words AS source_size, s3.target, CAST(g.whole * p.size + coalesce(extra, 0) AS BIGINT) AS taken
FROM p JOIN s3 USING (place) JOIN g ON g.place = p.place AND g.shard = p.shard LEFT JOIN x ON x.place = p.place AND x.shard = p.shard AND x.row = p.row
"""
