"""Exact Jaccard self-join over word shingles, by prefixes of token combinations.

A shingle is a token; a document's tokens form a set. Two sets of similarity p share a token within short prefixes of any
fixed order. First, prefixes in hash order show which sets share enough tokens with any other at all; the rest have no
links. Then the remaining sets are ordered by token frequency, rare first. Tokens of few classes are indexed alone. A set
with frequent tokens in its prefix extends it, and is indexed by combinations of k consecutive tokens: if two sets differ in
at most d tokens, k consecutive ones of their union are common, and lie among the first k (d + 1) tokens of each. So a set
has a key a token, not one for each pair of tokens. Combinations that are still frequent are extended again. Candidates are
verified.

A large group of near copies would make a quadratic number of links, of which only the components matter. So every set is
first compared with a few of the most central sets that it shares a prefix token with; sets that this links form one class.
The exact join then looks for links between different classes only, and loses none of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SPACES, any_type, components, discard, hashed_words, join_one, mix, pack_texts, release, stage, unpack_texts

#: Bytes of text in a block, the unit that is looked at twice; tokens in a bucket, the unit that is counted at once.
BLOCK_BYTES = 8 << 20
BUCKET_TOKENS = 3_000_000
#: Hash-order prefixes are longer than needed by this share of a set, so that more shared tokens are asked for.
EXTENSION = 0.08
#: A token, or combination, of more classes than this is frequent; combinations have up to LONGEST tokens.
RARE = 200
LONGEST = 3
#: So many of a set's tokens before a key are kept with it, to tell that two sets have met by an earlier one.
BEFORE = 16
#: Rounds in which each set is compared with up to TRIES central sets of other classes, before the exact join.
ROUNDS, TRIES = 2, 4


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text. With fewer words than `width` the whole sequence is one
    shingle; without words the set is empty. Different shingles collide with a probability of 2**-64 a pair."""
    docs, words = hashed_words(texts, SPACES)
    counts = np.bincount(docs, minlength=len(texts)) if len(docs) else np.zeros(len(texts), np.int64)
    first = np.concatenate([[0], np.cumsum(counts)])
    n = max(0, len(words) - width + 1)
    value = words[:n].copy()
    for k in range(1, width):
        value = mix(value) + words[k : n + k]
    value = mix(value)
    sets = []
    for k, count in enumerate(counts.tolist()):
        at = int(first[k])
        if count >= width:
            sets.append(np.unique(value[at : at + count - width + 1]))
        elif count:
            one = np.array([count], np.uint64)
            for w in words[at : at + count]:
                one = mix(one) + w
            sets.append(mix(one + np.uint64(count)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _least_shared(n: np.ndarray | int, percent: int):
    """The least intersection of a set of n with any set it links with."""
    return -(-n * percent // 100)


def _prefix(n: int, percent: int) -> tuple[int, int]:
    """Length of the hash-order prefix, and how many of its tokens another set must have."""
    least = _least_shared(n, percent)
    return min(n, n - least + 1 + int(EXTENSION * n)), 1 + int(EXTENSION * least)


def _set_id(tokens: np.ndarray) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _dealt(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts tokens of one bucket together, the buckets that have any, and where each starts (and the end)."""
    bucket = (tokens % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    present, starts = np.unique(bucket[order], return_index=True)
    return order, present, np.append(starts, len(tokens))


def _scan(docs: DataFrame, width: int, percent: int, buckets: int) -> DataFrame:
    """Per block: one row with the documents' set sizes and ids (bucket -2), one with the texts of its different sets
    (bucket -1), and one for each bucket with the different tokens of their hash-order prefixes."""
    schema = f"block long, bucket int, payload binary, doc_ids array<{any_type(docs)}>, hashes array<long>, sizes array<long>, sets array<long>"

    def emit(block: int, texts: list[bytes], ids: list, hashes: list, id_type: pa.DataType) -> pa.RecordBatch:
        sets = shingle_sets(texts, width)
        set_ids = [_set_id(s) for s in sets]
        own: dict[int, int] = {}
        for k, s in enumerate(sets):
            if len(s):
                own.setdefault(set_ids[k], k)
        kept = list(own.values())
        packed = pack_texts([texts[k] for k in kept])
        tokens = np.unique(np.concatenate([sets[k][: _prefix(len(sets[k]), percent)[0]] for k in kept] or [np.zeros(0, np.uint64)]))
        rows = [(block, -2, None, ids, hashes, [len(s) for s in sets], set_ids), (block, -1, packed, None, None, None, None)]
        order, present, cuts = _dealt(tokens, buckets)
        for k, b in enumerate(present.tolist()):
            rows.append((block, b, tokens[order[cuts[k] : cuts[k + 1]]].tobytes(), None, None, None, None))
        many = pa.list_(pa.int64())
        types = [pa.int64(), pa.int32(), pa.binary(), pa.list_(id_type), many, many, many]
        names = ["block", "bucket", "payload", "doc_ids", "hashes", "sizes", "sets"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        texts: list[bytes] = []
        ids: list = []
        hashes: list = []
        size = 0
        id_type = pa.int64()
        for batch in batches:
            raw, id_type = batch.column("text").cast(pa.binary()), batch.schema.field("doc_id").type
            for k, (doc_id, h) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("hash").to_pylist(), strict=True)):
                text = raw[k].as_py() or b""
                if texts and size + len(text) > BLOCK_BYTES:
                    yield emit(block, texts, ids, hashes, id_type)
                    release()
                    block, size, texts, ids, hashes = block + 1, 0, [], [], []
                texts.append(text)
                ids.append(doc_id)
                hashes.append(h)
                size += len(text)
        if texts:
            yield emit(block, texts, ids, hashes, id_type)

    return docs.mapInArrow(run, schema)


def _flag(table: pa.Table) -> pa.Table:
    """For each block's tokens of one bucket, bits that say which occur in another block too. A block has a token once, so a
    token that every document has is here once a block."""
    parts = [np.frombuffer(p.as_py(), np.uint64) for p in table.column("payload")]
    tokens = np.concatenate(parts)
    order = np.argsort(tokens)
    sorted_ = tokens[order]
    same = sorted_[1:] == sorted_[:-1]
    shared = np.zeros(len(tokens), bool)
    shared[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "payload": pa.array([zstandard.compress(np.packbits(x).tobytes()) for x in np.split(shared, cuts)], pa.binary()),
        }
    )


def _survivors(width: int, percent: int, buckets: int):
    """From a block's texts and flags: the sets that share enough prefix tokens to have a link."""

    def run(table: pa.Table) -> pa.Table:
        flags: dict[int, np.ndarray] = {}
        texts: list[bytes] = []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload"), strict=True):
            if bucket < 0:
                texts = unpack_texts(payload.as_py())
            else:
                flags[bucket] = np.unpackbits(np.frombuffer(zstandard.decompress(payload.as_py()), np.uint8))
        sets = shingle_sets(texts, width)
        lengths = [_prefix(len(s), percent) for s in sets]
        every = np.concatenate([s[:n] for s, (n, _) in zip(sets, lengths, strict=True)] or [np.zeros(0, np.uint64)])
        tokens, place, many = np.unique(every, return_inverse=True, return_counts=True)
        order, present, cuts = _dealt(tokens, buckets)
        shared = many > 1  # in another set of this block, or of another
        for k, b in enumerate(present.tolist()):
            own = order[cuts[k] : cuts[k + 1]]
            shared[own] |= flags[b][: len(own)].astype(bool)
        total = np.concatenate([[0], np.cumsum(shared[place])])
        ends = np.cumsum([n for n, _ in lengths])
        keep = [k for k, (n, least) in enumerate(lengths) if total[ends[k]] - total[ends[k] - n] >= least]
        values = np.concatenate([sets[k] for k in keep] or [np.zeros(0, np.uint64)]).view(np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(sets[k]) for k in keep])]).astype(np.int32)
        release()
        return pa.table(
            {
                "sid": pa.array([_set_id(sets[k]) for k in keep], pa.int64()),
                "tokens": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values)),
            }
        )

    return run


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough, by the whole sets."""
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("left"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("right"))
    both = F.size(F.array_intersect("left", "right"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("left") + F.size("right") - both)).select("a", "b")


def _may_link(na: Column, nb: Column, at_a: Column, at_b: Column, percent: int, ma: Column | None = None, mb: Column | None = None, k: int = 1) -> Column:
    """Whether sizes and places of the first k consecutive common tokens leave room for a large enough intersection. Of
    their m shared tokens (or all) the sets may have common ones before, but no k consecutive ones: at most r with
    r <= (k - 1) (d + 1), d being those before that aren't common, and 2 r + d = at_a + at_b."""
    room = F.least((na if ma is None else ma) - at_a, (nb if mb is None else mb) - at_b)
    if k > 1:
        room = room + F.least(at_a, at_b, F.floor((k - 1) * (at_a + at_b + 1) / (2 * k - 1)))
    return (room * (100 + percent) >= percent * (na + nb)) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb))


def _differ(n: Column, percent: int) -> Column:
    """In how many tokens, at most, a set of n and any set it links with differ."""
    return F.floor(n * (100 - percent) / percent).cast("int")


def _ordered(sets: DataFrame, percent: int) -> DataFrame:
    """The sets by token frequency: sid, n, m (shared tokens), least, central, and as many of the shared tokens as any prefix
    needs. Tokens of no other set would come first and are only counted. `central` orders sets by their share of shared tokens."""
    tokens = sets.select("sid", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    known = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * percent / 100).cast("int")
    ordered = (
        tokens.join(known, "token")
        .groupBy("sid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("shared"))
        .withColumn("m", F.size("shared"))
        .where(F.col("m") >= least)
    )
    weight = F.aggregate("shared", F.lit(0.0), lambda a, x: a + F.log(x["df"].cast("double")))
    central = F.struct((F.col("m") / F.col("n")).alias("share"), (weight / F.col("n")).alias("weight"), "sid")
    most = F.greatest(F.col("m") - least + 2, LONGEST * (_differ(F.col("n"), percent) + 1) - (F.col("n") - F.col("m")))
    cut = F.transform(F.slice("shared", F.lit(1), most), lambda x: x["token"])
    return ordered.select("sid", F.col("n").cast("long").alias("n"), "m", least.alias("least"), central.alias("central"), cut.alias("tokens"))


def _prefixes(ordered: DataFrame) -> DataFrame:
    """The prefixes, one token longer than needed: sid, n, m, least, central, at (place in the order), token."""
    cut = ordered.select("sid", "n", "m", "least", "central", F.posexplode(F.slice("tokens", F.lit(1), F.col("m") - F.col("least") + 2)).alias("k", "token"))
    return cut.select("sid", "n", "m", "least", "central", (F.col("n") - F.col("m") + F.col("k")).alias("at"), "token")


def _classed(prefix: DataFrame, classes: DataFrame | None) -> DataFrame:
    """prefix with each set's class, itself where it has no links yet."""
    if classes is None:
        return prefix.withColumn("class", F.col("sid"))
    return prefix.join(classes.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("class", F.coalesce("root", "sid")).drop("root")


def _met(classed: DataFrame, percent: int, first: bool) -> DataFrame:
    """Pairs (a, b) of a set and a few of the most central sets that it shares a prefix token with: at first the one most
    central of all, later up to TRIES of other classes."""
    hub = F.struct("central", "class", "n", "at")
    hubs = classed.groupBy("token").agg(F.max(hub).alias("hub"))
    chosen, tries = F.col("hub"), 1
    if not first:
        other = classed.join(hubs, "token").where(F.col("class") != F.col("hub.class")).groupBy("token").agg(F.max(hub).alias("other"))
        hubs = hubs.join(other, "token")
        chosen, tries = F.when(F.col("class") == F.col("hub.class"), F.col("other")).otherwise(F.col("hub")), TRIES
    met = classed.join(hubs, "token").select("sid", "n", "at", chosen.alias("hub"))
    met = met.where(_may_link(F.col("n"), F.col("hub.n"), F.col("at"), F.col("hub.at"), percent) & (F.col("sid") != F.col("hub.central.sid")))
    if first:
        return met.groupBy("sid").agg(F.max("hub.central").alias("hub")).select(F.col("sid").alias("a"), F.col("hub.sid").alias("b"))
    best = F.slice(F.reverse(F.array_sort(F.collect_set("hub.central"))), 1, tries)
    return met.groupBy("sid").agg(best.alias("hubs")).select(F.col("sid").alias("a"), F.explode("hubs.sid").alias("b"))


def _keyed(rows: DataFrame, k: int) -> DataFrame:
    """From (sid, n, m, class, last, at, key), with at the place among the m shared tokens: the keys of more than one class, with their number of classes (classes), their
    largest class (major), whether any set can't be extended beyond the key (ends), and rare keys that the set has too (before).

    Two sets need to meet at one key alone. A rare key that they share before a rare one, or at all besides a frequent one,
    tells that it isn't this; such keys add no candidate if BEFORE keys suffice to tell. The longest count as rare."""
    sizes = rows.groupBy("key", "class").agg(F.count("*").alias("size"), F.max("last").alias("ends"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("classes"), F.max(F.struct("size", "class")).alias("major"), F.max("ends").alias("ends")).where("classes > 1")
    open_ = rows.join(mixed.select("key", "classes", F.col("major.class").alias("major"), "ends"), "key")
    own = open_.groupBy("sid", "n", "m", "class", "last").agg(F.array_sort(F.collect_list(F.struct("at", "key", "classes", "major", "ends"))).alias("o"))
    rare_key = lambda x: F.lit(True) if k == LONGEST else x["classes"] <= RARE
    own = own.withColumn("r", F.filter("o", rare_key)).withColumn("f", F.filter("o", lambda x: ~rare_key(x)))
    own = own.withColumn("keys", F.transform("r", lambda x: x["key"]))
    one = lambda x, before: F.struct(*(x[c].alias(c) for c in ("key", "at", "classes", "major", "ends")), before.alias("before"))
    rare = F.transform("r", lambda x, i: one(x, F.slice("keys", F.greatest(i - BEFORE + 1, F.lit(1)), F.least(i, F.lit(BEFORE)))))
    frequent = F.transform("f", lambda x: one(x, F.slice("keys", F.lit(1), F.lit(BEFORE))))
    found = own.select("sid", "n", "m", "class", "last", F.explode(F.concat(rare, frequent)).alias("x"))
    return found.select("x.key", "sid", "n", "m", "x.at", "class", "last", "x.classes", "x.major", "x.ends", "x.before")


def _last(n: Column, k: int, percent: int) -> Column:
    """Whether a set is too small for combinations of k + 1 tokens, or k is LONGEST."""
    return F.lit(k == LONGEST) | ((k + 1) * (_differ(n, percent) + 1) > n)


def _extended(index: DataFrame, ordered: DataFrame, classes: DataFrame | None, k: int, percent: int) -> DataFrame:
    """Combinations of k consecutive tokens of the sets that have a frequent key of k - 1, as rows for _keyed()."""
    more = index.where((F.col("classes") > RARE) & ~F.col("last")).select("sid").distinct()
    reach = k * (_differ(F.col("n"), percent) + 1) - (F.col("n") - F.col("m")).cast("int")  # of the shared tokens
    rows = _classed(ordered.join(more, "sid", "left_semi"), classes).withColumn("t", F.slice("tokens", F.lit(1), F.greatest(reach, F.lit(0)))).where(F.size("t") >= k)
    keys = F.transform(F.sequence(F.lit(1), F.size("t") - (k - 1)), lambda i: F.xxhash64(F.lit(k), F.slice("t", i, F.lit(k))))
    return rows.select("sid", "n", "m", "class", _last(F.col("n"), k, percent).alias("last"), F.posexplode(keys).alias("at", "key"))


def _candidates(index: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of different classes that share a key and may link. Sets outside a key's largest class meet all
    others of the key; those of the largest class only these. At a frequent key only sets meet of which one has no longer one."""
    used = index.where((F.col("classes") <= RARE) | F.col("ends"))
    outside = used.where(F.col("class") != F.col("major")).select("key", *(F.col(c).alias(f"{c}1") for c in ("sid", "n", "m", "at", "class", "before", "last")))
    return (
        used.join(outside, "key")
        .where(F.col("class") != F.col("class1"))
        .where((F.col("class") == F.col("major")) | (F.col("sid") < F.col("sid1")))
        .where((F.col("classes") <= RARE) | F.col("last") | F.col("last1"))
        .where(_may_link(F.col("n"), F.col("n1"), F.col("at"), F.col("at1"), percent, F.col("m"), F.col("m1"), k))
        .where(~F.arrays_overlap("before", "before1"))
        .select(F.least("sid", "sid1").alias("a"), F.greatest("sid", "sid1").alias("b"))
        .distinct()
    )


def _between(ordered: DataFrame, prefix: DataFrame, classes: DataFrame | None, percent: int) -> DataFrame:
    """Candidates among sets of different classes: all pairs that may link, by tokens and then by ever longer combinations."""
    single = _classed(prefix, classes).where(F.col("at") <= F.col("n") - F.col("least"))
    rows = single.select("sid", "n", "m", "class", _last(F.col("n"), 1, percent).alias("last"), (F.col("at") - F.col("n") + F.col("m")).cast("int").alias("at"), F.col("token").alias("key"))
    found = []
    for k in range(1, LONGEST + 1):
        if k > 1:
            rows = _extended(found[-1], ordered, classes, k, percent)
        found.append(stage(_keyed(rows, k), "index"))
        if found[-1].where((F.col("classes") > RARE) & ~F.col("last")).isEmpty():
            break
    pairs = None
    for k, index in enumerate(found, 1):
        pairs = _candidates(index, k, percent) if pairs is None else pairs.unionAll(_candidates(index, k, percent))
    out = stage(pairs.distinct(), "candidates")
    discard(*found)
    return out


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Classes of the sets that are linked with any other: node and root, set ids."""
    ordered = stage(_ordered(sets, percent), "ordered")
    prefix = _prefixes(ordered)
    links = []
    classes = None
    for turn in range(ROUNDS):
        links.append(stage(_linked(_met(_classed(prefix, classes), percent, turn == 0), sets, percent), "links"))
        if turn and links[-1].isEmpty():
            break
        if classes is not None:
            discard(classes)
        classes = components(_union(links))
    # Between classes: all that the prefixes allow.
    pairs = _between(ordered, prefix, classes, percent)
    links.append(stage(_linked(pairs, sets, percent), "links"))
    out = components(_union(links))
    discard(ordered, pairs, classes, *links)
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, hash (xxhash64 of the text), n_shingles and the representative (doc_id, hash) of its group.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. Documents link when 100 times the number of
    common shingles is at least `percent` (67 or more) times that of all; groups are the components. The representative
    is the member of least doc_id (of any type that has an order), null last, then least hash. A text without words (or null)
    links with nothing. Repeated rows have equal results; an empty table gives an empty one; other columns are ignored.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("hash"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, size // 30 // BUCKET_TOKENS)
    scan = stage(_scan(rows, width, percent, buckets), "scan")
    packed = scan.select("block", "bucket", "payload")
    flags = packed.where("bucket >= 0").groupBy("bucket").applyInArrow(_flag, "block long, bucket int, payload binary")
    both = packed.where("bucket = -1").unionAll(flags)
    sets = stage(both.groupBy("block").applyInArrow(_survivors(width, percent, buckets), "sid long, tokens array<long>").dropDuplicates(["sid"]), "sets")
    members = scan.where("bucket = -2").select(F.explode(F.arrays_zip("doc_ids", "hashes", "sizes", "sets")).alias("x")).select(
        F.col("x.doc_ids").alias("doc_id"), F.col("x.hashes").alias("hash"), F.col("x.sizes").alias("n_shingles"), F.col("x.sets").alias("sid")
    )
    members = stage(members, "members")
    discard(scan)
    classes = _links(sets, percent)
    discard(sets)
    by = ["doc_id", "hash"]
    grouped = join_one(members, classes.select(F.col("node").alias("sid"), "root"), ["sid"], by, "left").withColumn("class", F.coalesce("root", "sid"))
    own = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash")
    heads = grouped.where("n_shingles > 0").groupBy("class").agg(F.min(own).alias("head"))
    return (
        join_one(grouped, heads, ["class"], by, "left")
        .withColumn("head", F.when(F.col("n_shingles") > 0, F.col("head")).otherwise(own))
        .select("doc_id", "hash", "n_shingles", F.struct("head.doc_id", "head.hash").alias("representative"))
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all members of a group but its representative; texts without words stay.

    Of rows with equal doc_id and text, one stays (with words). Columns are those of docs.
    """
    key = ["gridloom_id", "gridloom_hash"]
    found = near_duplicates(docs, width, percent)
    kept = (
        found.where((F.col("n_shingles") == 0) | F.struct("doc_id", "hash").eqNullSafe(F.col("representative")))
        .groupBy(F.struct("doc_id").alias(key[0]), F.col("hash").alias(key[1]))
        .agg(F.max("n_shingles").alias("gridloom_n"))
    )
    # A struct of a null is not null, so unnamed documents are joined too.
    named = docs.withColumn(key[0], F.struct("doc_id")).withColumn(key[1], F.xxhash64(F.col("text").cast("string")))
    whole = named.join(kept, (named[key[0]].eqNullSafe(kept[key[0]])) & (named[key[1]] == kept[key[1]])).drop(kept[key[0]]).drop(kept[key[1]])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = whole.where("gridloom_n > 0").dropDuplicates(key)
    return once.select(columns).unionAll(whole.where("gridloom_n = 0").select(columns))
