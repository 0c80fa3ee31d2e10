"""License scans with built-in functions only: MinHash bands over overlapping windows, then exact containment.

A text's words are cut into windows of WINDOW words, one starting at each STEP-th word, so any passage of
WINDOW - STEP + 1 words lies whole in a window. A window retrieves a template if, for any of BANDS hash functions, its least
shingle hash is that of one of the template's windows. With one row a band, a window and a template window of similarity s
meet with probability 1 - (1 - s) ** BANDS: over 0.9999 for s of 0.25, the least that a template of five words can have.
A band can only agree if the window holds the template's least shingle, so windows without any shingle of a template are
passed over before anything is hashed. All templates retrieved are verified by their exact shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import discard, stage

WIDTH, WINDOW, STEP, BANDS = 3, 12, 4, 32
#: So many bytes of templates, about, are part of a query's plan; a larger library is looked for in parts, one pass each.
PART_BYTES = 256 << 10

#: Names and wordings of common license notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words: lower-cased runs of ASCII letters and digits and of anything beyond ASCII."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles_of(words: Column, first: Column, n: Column) -> Column:
    """The shingles of n words from `first` (0-based) on: strings, in order; none if n < WIDTH."""
    count = F.greatest(n - (WIDTH - 1), F.lit(0))
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(words, first + i + 1, WIDTH), " "))


def least_hashes(shingles: Column) -> Column:
    """For each band the least hash of all shingles; the hash includes the band, so different bands don't agree."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """license, words and distinct shingles of each template. Templates of fewer than WIDTH words have no shingles and are
    left out."""
    table = spark.createDataFrame(list(templates), "license string, text string").withColumn("words", words_of(F.col("text")))
    table = table.withColumn("shingles", F.array_distinct(shingles_of(F.col("words"), F.lit(0), F.size("words"))))
    return table.where(F.size("shingles") > 0).select("license", "words", "shingles")


def parts_of(templates) -> list[list[tuple[str, str]]]:
    parts, size = [[]], 0
    for t in templates:
        if parts[-1] and size + len(t[1].encode()) > PART_BYTES:
            parts.append([])
            size = 0
        parts[-1].append(t)
        size += len(t[1].encode())
    return parts


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = 80) -> DataFrame:
    """docs with `licenses`, the sorted names of the templates that the text contains.

    A template counts as contained if at least `percent` of its distinct shingles are in the windows that retrieve it. A
    null or empty text has none, as has any text of fewer than three words, and a template of fewer is never found; very
    long texts are scanned whole; templates may share a name. Repeated rows get equal results, an empty table an empty one. A
    column named licenses is replaced; all others stay. Nothing is shuffled: windows, retrieval and verification happen within
    a row, against templates that are part of the plan. A library of more than PART_BYTES is searched for part by part; each
    pass but the last is written to the shared folder.
    """
    found = docs.drop("licenses").withColumn("licenses", F.array().cast("array<string>"))
    parts = parts_of(templates)
    for k, part in enumerate(parts):
        last = found
        found = _scan_part(found, part, percent)
        if k < len(parts) - 1:
            found = stage(found, "licenses")
            if k:
                discard(last)
    return found


def _scan_part(docs: DataFrame, templates, percent: int) -> DataFrame:
    """docs with the names of these templates added to `licenses`."""
    spark = docs.sparkSession
    numbered = [(str(k), t) for k, (_, t) in enumerate(templates)]
    rows = template_table(spark, numbered).collect()  # the templates alone
    known = [s for r in rows for s in r["shingles"]]
    if not known:
        return docs
    index = _band_index(spark, rows)
    names_of = F.expr(f"map({', '.join(f'{k}L, array({_quoted(v)})' for k, v in index.items())})")
    shingle_sets = F.expr(f"map({', '.join(_quoted([r['license']]) + f', array({_quoted(r['shingles'])})' for r in rows)})")
    titles = F.expr(f"map({', '.join(_quoted([k, name]) for (k, _), (name, _) in zip(numbered, templates, strict=True))})")
    hashes, keys = _shingle_hashes(spark, known), list(index)

    def windows(words: Column) -> Column:
        """First words of the windows that hold a shingle of any template."""
        n = F.size(words)
        last = F.greatest(n - WIDTH, F.lit(-1))
        hit = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WIDTH))).isin(hashes))
        # A shingle at i lies in the windows that start from i + WIDTH - WINDOW to i.
        starts = F.flatten(
            F.transform(hit, lambda i: F.filter(F.transform(F.sequence(F.lit(0), F.lit((WINDOW - WIDTH) // STEP)), lambda k: (F.floor(i / STEP).cast("int") - k) * STEP), lambda s: (s >= 0) & (s + WINDOW >= i + WIDTH)))
        )
        return F.array_distinct(starts)

    def retrieved(words: Column) -> Column:
        """Per window: its shingles and the licenses whose windows agree in any band."""

        def one(start: Column) -> Column:
            own = shingles_of(words, start, F.least(F.lit(WINDOW), F.size(words) - start))
            agreed = lambda s: F.filter(least_hashes(s), lambda key: key.isin(keys))
            return let(own, lambda s: F.struct(s.alias("shingles"), F.array_distinct(F.flatten(F.transform(agreed(s), lambda key: F.element_at(names_of, key)))).alias("licenses")))

        return F.transform(windows(words), one)

    def contained(found_: Column) -> Column:
        names = F.array_distinct(F.flatten(F.transform(found_, lambda w: w["licenses"])))

        def enough(name: Column) -> Column:
            shingles = F.flatten(F.transform(F.filter(found_, lambda w: F.array_contains(w["licenses"], name)), lambda w: w["shingles"]))
            template = F.element_at(shingle_sets, name)
            return 100 * F.size(F.array_intersect(template, shingles)) >= percent * F.size(template)

        return F.transform(F.filter(names, enough), lambda k: F.element_at(titles, k))

    matched = let(words_of(F.col("text").cast("string")), lambda words: let(retrieved(words), contained))
    return docs.withColumn("licenses", F.array_sort(F.array_union("licenses", F.coalesce(matched, F.array().cast("array<string>")))))


def _quoted(texts: list[str]) -> str:
    return ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in texts)


def _shingle_hashes(spark: SparkSession, shingles: list[str]) -> list[int]:
    split = spark.createDataFrame([(s.split(" "),) for s in sorted(set(shingles))], "w array<string>")
    return [r[0] for r in split.select(F.xxhash64(*(F.get("w", F.lit(k)) for k in range(WIDTH)))).collect()]


def _band_index(spark: SparkSession, rows: list) -> dict[int, list[str]]:
    """From the least hashes of every window of every template to the template names. Longer templates have one window
    at each word, shorter ones are a window."""
    table = spark.createDataFrame([(r["license"], r["words"]) for r in rows], "license string, words array<string>")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    each = table.select("license", "words", F.explode(starts).alias("start"))
    own = shingles_of(F.col("words"), F.col("start"), F.least(F.lit(WINDOW), F.size("words") - F.col("start")))
    bands = each.select("license", F.explode(least_hashes(own)).alias("key")).groupBy("key").agg(F.sort_array(F.collect_set("license")).alias("names"))
    return {r["key"]: list(r["names"]) for r in bands.collect()}
