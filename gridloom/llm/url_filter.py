"""URL filters: prefix rules, and a tree of path templates per host that generalises them.

Paths become templates level by level, as deep as they are. A segment that is a number, a date, a hash or the like is a
wildcard at once. Below one parent, sibling branches are merged into a wildcard if they look alike in what stands below them,
or are many and each of them rare, and if their labels are alike too. A template is rejected by its share of blocked labels, smoothed
towards that of its parent branches, its host, its site and all urls. All of it is grouped counting: no host is gathered
in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, join_one, stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD = "*"


@dataclass(frozen=True)
class Settings:
    """The tree has a level for each segment; from the level `depth` on, all further segments are one. Among more than
    `fan_out` children of a parent those are rare that have less than a share of `share` of its urls. Branches have like labels
    if these differ by less than `z` standard errors from those of all that would be merged. `strength` is the weight, in labels, of the parent's share; from
    `reject_from` on a template is blocked."""

    depth: int = 32
    fan_out: int = 32
    share: float = 0.05
    z: float = 2.0
    strength: float = 4.0
    reject_from: float = 0.5


#: (action, host and path) of the query's rules.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: then up to ?, # or the end. Both are
    empty for null or without ://."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    raw = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; null if none does. Rules are a short list of the caller's."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: len(r[1])):  # longer ones are asked first
        own, _, below = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + below)
        rule, action = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(action)
    return rule, action


def segments(path: Column, depth: int) -> Column:
    """The path's segments with variable ones as classes: <n> numbers, <d> dates, <x> hex and long identifiers; a file
    ending stays. Segments from `depth` on stand together in the last one."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    kind = lambda x: (
        F.when(x.rlike(r"^\d{4}-\d{2}(-\d{2})?$"), F.lit("<d>"))
        .when(x.rlike(r"^\d+(\.[A-Za-z0-9]{1,5})?$"), F.regexp_replace(x, r"^\d+", "<n>"))
        .when(x.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), F.lit("<x>"))
        .when(F.length(x) > 40, F.lit("<x>"))
        .otherwise(x)
    )
    classed = F.transform(parts, kind)
    rest = F.array_join(F.slice(classed, F.lit(depth), F.greatest(F.size(classed) - depth + 1, F.lit(0))), "/")
    return F.when(F.size(classed) > depth, F.concat(F.slice(classed, 1, depth - 1), F.array(rest))).otherwise(classed)


def templates(counted: DataFrame, settings: Settings) -> DataFrame:
    """From host, segs and n, good, bad (urls, allowed and blocked labels) of different classed paths: the same rows with
    `template`, an array of segments, literal or WILD. One step for each level of the longest path."""
    tree = counted.withColumn("template", F.array().cast("array<string>"))
    deepest = counted.agg(F.max(F.size("segs"))).first()[0] or 0

    def similar(goods: str, bads: str) -> Column:
        labels, pooled = F.col("good") + F.col("bad"), F.col(bads) / F.greatest(F.col(goods) + F.col(bads), F.lit(1))
        error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(0.05)) / F.greatest(labels, F.lit(1)))
        return (labels == 0) | (F.abs(F.col("bad") / F.greatest(labels, F.lit(1)) - pooled) < settings.z * error)

    for level in range(deepest):
        here = F.get("segs", F.lit(level))
        tree = tree.withColumn("here", here)
        inner = tree.where(here.isNotNull())
        # What stands below, literals as w: the form that a branch mostly has.
        below = F.slice("segs", F.lit(level + 2), F.lit(settings.depth))
        form = F.concat_ws("/", F.transform(below, lambda x: F.when(x.startswith("<"), x).otherwise("w")))
        children = (
            inner.withColumn("form", form)
            .groupBy("host", "template", "here", "form")
            .agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
            .groupBy("host", "template", "here")
            .agg(F.max(F.struct("n", "form")).getField("form").alias("form"), *(F.sum(c).alias(c) for c in ("n", "good", "bad")))
        )
        parent = ["host", "template"]
        fan = children.groupBy(parent).agg(F.count("*").alias("children"), F.sum("n").alias("all"))
        rare = (F.col("children") > settings.fan_out) & (F.col("n") < settings.share * F.col("all"))
        children = join_one(children, fan, parent, by=["here"]).withColumn("rare", rare)
        sums = lambda ending: (F.sum("good").alias(f"good{ending}"), F.sum("bad").alias(f"bad{ending}"))
        alike = children.groupBy(*parent, "form").agg(F.count("*").alias("peers"), *sums("_alike"))
        scarce = children.groupBy(*parent, "rare").agg(*sums("_rare"))
        chosen = join_one(join_one(children, alike, [*parent, "form"], by=["here"]), scarce, [*parent, "rare"], by=["here"])
        merged = (F.col("rare") & similar("good_rare", "bad_rare")) | ((F.col("peers") > 1) & similar("good_alike", "bad_alike"))
        chosen = chosen.select(*parent, "here", F.when(merged, F.lit(WILD)).otherwise(F.col("here")).alias("step"))
        tree = (
            join_one(tree, chosen, [*parent, "here"], by=["segs"], how="left")
            .withColumn("template", F.when(F.col("step").isNull(), F.col("template")).otherwise(F.concat("template", F.array("step"))))
            .drop("here", "step")
        )
        tree = stage(tree, "templates")
        if level:
            discard(staged)
        staged = tree
    return tree


def judged(tree: DataFrame, settings: Settings) -> DataFrame:
    """tree with `share`, the smoothed share of blocked labels of each row's template: from all urls down to the site (the
    host's last two labels), the host and each branch of the template."""
    names = F.split("host", r"\.")
    site = F.concat_ws(".", F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), F.lit(2)))
    branch = lambda k: F.concat_ws("\x01", F.lit("branch"), F.col("host"), F.array_join(F.slice("template", F.lit(1), k), "\x01"))
    depth = F.size("template")
    branches = F.transform(F.when(depth > 0, F.sequence(F.lit(1), depth)).otherwise(F.array().cast("array<int>")), branch)
    keys = F.concat(F.array(F.concat(F.lit("site\x01"), site), F.concat(F.lit("host\x01"), F.col("host"))), branches)
    rows = tree.select("host", "segs", "good", "bad", F.posexplode(keys).alias("level", "key"))
    sums = rows.groupBy("key").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    chain = join_one(rows.select("host", "segs", "level", "key"), sums, ["key"], by=["host", "segs"]).groupBy("host", "segs").agg(F.sort_array(F.collect_list(F.struct("level", "good", "bad"))).alias("chain"))
    total = tree.agg(F.sum("good").alias("g"), F.sum("bad").alias("b")).first()
    good, bad = float(total["g"] or 0), float(total["b"] or 0)
    start = (bad + 1) / (good + bad + 2) if good + bad else 0.0
    share = F.aggregate("chain", F.lit(start), lambda above, x: (x["bad"] + settings.strength * above) / (x["good"] + x["bad"] + settings.strength))
    return tree.join(chain.select("host", "segs", share.alias("share")), ["host", "segs"])


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, settings: Settings = Settings()) -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict, template and share.

    A url that a rule fits gets the longest such rule and its action. These urls are also the labels, from which the
    template tree judges all others: `block` from a smoothed share of reject_from on, else `allow`. A null url, or one
    without ://, has an empty host and path and the template of an empty path. Repeated rows get equal results; without
    any label the share is zero, which allows; an empty table gives an empty result. Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, action = matching_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.select("*", rule.alias("rule"), action.alias("action"), segments(F.col("path"), settings.depth).alias("segs"))
    counted = stage(
        parsed.groupBy("host", "segs").agg(
            F.count("*").alias("n"),
            F.count_if(F.col("action") == "allow").alias("good"),
            F.count_if(F.col("action") == "block").alias("bad"),
        ),
        "paths",
    )
    tree = judged(templates(counted, settings), settings).select("host", "segs", F.concat_ws("/", "template").alias("template"), "share")
    return join_one(parsed, tree, ["host", "segs"], by=["page_id", "path"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(F.col("share") >= settings.reject_from, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.concat(F.lit("/"), "template").alias("template"),
        F.round("share", 9).alias("share"),
    )
