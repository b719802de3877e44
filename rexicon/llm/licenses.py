"""License scan with MinHash bands over overlapping text windows (operator 1).

Only DataFrame functions are used.  A text's 2-word shingle hashes are cut into blocks
of ``BLOCK``; per hash function the least value of each block is kept, and windows of
three sizes, overlapping, take the least of their blocks.  A window that agrees with a
template in any of the ``BANDS`` bands is a candidate; the share of the template's
shingles that the text around the window really holds decides.

Collision: an occurrence lies within some window as a whole, so its similarity with the
window is at least 1/3 and a band agrees with at least that chance; with 12 bands a
window finds it with over 99 %, and most occurrences lie within more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices as their licences word them.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

BANDS, BLOCK = 12, 3
#: Window sizes and strides, in blocks, and the largest template (in shingles) each holds as a whole.
SCALES = ((2, 1, 4), (4, 2, 7), (8, 4, 13))
CONTAINMENT = 0.8
_MULTIPLIER = 0x9E3779B97F4A7C15
#: One hash function per band: the shingle's hash xor a constant.
MASKS = tuple(((k * _MULTIPLIER) % (1 << 64)) - (1 << 63) for k in range(1, BANDS + 1))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of the 2-word shingles, in order; a single word is a shingle of its own."""
    n = F.size(w)
    pairs = F.transform(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1)))
    return F.when(n == 1, F.transform(w, lambda x: F.xxhash64(x))).otherwise(pairs)


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    one = F.array(*[F.struct(F.lit(name).alias("template"), F.lit(text).alias("t")) for name, text in sorted(templates.items())])
    rows = spark.range(1).select(F.explode(one).alias("x")).select("x.template", words(F.col("x.t")).alias("w"))
    return rows.select("template", shingles(F.col("w")).alias("sh")).withColumn("n", F.size("sh")).where("n > 0")


def _template_bands(t: DataFrame) -> DataFrame:
    """``template, sh, n, scale, band, value``: what windows of each scale are compared with.

    A template that a scale's window can hold as a whole goes to the least such scale;
    a longer one to the last, as a whole and by windows at every block."""
    last = len(SCALES) - 1
    scale = F.lit(last)
    for k in range(last, -1, -1):
        scale = F.when(F.col("n") <= SCALES[k][2], F.lit(k)).otherwise(scale)
    size = SCALES[last][0] * BLOCK
    offsets = F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)), F.lit(1))
    windows = F.when(F.col("n") <= SCALES[last][2], F.array("sh")).otherwise(F.concat(F.array("sh"), F.transform(offsets, lambda o: F.slice("sh", o + 1, size))))
    t = t.withColumn("scale", scale).withColumn("part", F.explode(windows))
    values = F.array(*[F.struct(F.lit(b).alias("band"), F.array_min(F.transform("part", lambda x: x.bitwiseXOR(F.lit(m)))).alias("value")) for b, m in enumerate(MASKS)])
    return t.withColumn("v", F.explode(values)).select("template", "sh", "n", "scale", "v.band", "v.value").distinct()


def _least(hashes: Column, mask: int) -> Column:
    """The least value of one hash function."""
    return F.array_min(F.transform(hashes, lambda x: x.bitwiseXOR(F.lit(mask))))


def _block_minima(mask: int) -> Column:
    """Per block of shingles, the least value of one hash function.  (``get`` reads in place; ``slice`` would copy the text's array each time.)"""
    at = lambda b, k: F.get("sh", b * BLOCK + k).bitwiseXOR(F.lit(mask))
    return F.transform("blocks", lambda b: F.least(*[at(b, k) for k in range(BLOCK)]))


def _doubled(minima: Column, reach: int, stride: int) -> Column:
    """Least values of windows twice as long: of each ``stride``-th window of ``minima`` and the one ``reach`` blocks on."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(minima) - 1, F.lit(0)), F.lit(stride))
    return F.transform(starts, lambda j: F.least(F.get(minima, j), F.get(minima, j + reach)))


def _agreeing(minima: Column, stride: int, values: list[int]) -> Column:
    """The first blocks of the windows, ``stride`` apart, whose least value is one of ``values``."""
    hits = F.filter(F.transform(minima, lambda x, i: F.when(x.isin(values), i * stride)), lambda i: i.isNotNull())
    return hits


def _of_scale(starts: Column, scale: int) -> Column:
    return F.transform(starts, lambda j: F.struct(F.lit(scale).alias("scale"), j.alias("at")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """The templates found in each row of ``docs`` (``doc_id, text``): ``doc_id, template, containment, first_word, windows``.

    One row per document and template whose best place holds at least ``containment``
    of the template's shingles; ``first_word`` is where the first window that found it
    begins, ``windows`` how many did.  Whole texts are scanned, in one pass and without
    a shuffle up to the last count.  Null, empty and wordless texts hold nothing; rows
    that share a doc_id are counted together; other columns are ignored.
    """
    spark = docs.sparkSession
    bands = _template_bands(_templates(spark, templates))
    known = bands.select("scale", "band", "value").distinct().collect()  # bounded by the list of templates
    of = lambda s, b: [r.value for r in known if r.scale == s and r.band == b]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    rows = rows.select("doc_id", shingles(F.col("w")).alias("sh"))
    rows = rows.withColumn("blocks", F.sequence(F.lit(0), F.greatest(F.ceil(F.size("sh") / BLOCK).cast("int") - 1, F.lit(0))))
    least = [_block_minima(m).alias(f"m{k}") for k, m in enumerate(MASKS)]
    rows = rows.select("doc_id", "sh", *least)
    # Windows of 2, 4 and 8 blocks at every 1st, 2nd and 4th block: each from two of the size before.
    previous = "m"
    for s, (_, stride, _) in enumerate(SCALES):
        # of the size before, windows stand every half stride (every block at first), so its halves are that far apart
        reach = 1 if s == 0 else 2
        own = [_doubled(F.col(f"{previous}{k}"), reach, 1 if s == 0 else 2).alias(f"s{s}_{k}") for k in range(BANDS)]
        rows = rows.select("*", *own)
        previous = f"s{s}_"
    found = []
    for s, (_, stride, _) in enumerate(SCALES):
        hits = None
        for k in range(BANDS):
            values = of(s, k)
            if values:
                own = _agreeing(F.col(f"s{s}_{k}"), stride, values)
                hits = own if hits is None else F.array_union(hits, own)
        if hits is not None:
            found.append(_of_scale(hits, s))
    if not found:
        return rows.select("doc_id", F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word"), F.lit(0).cast("long").alias("windows")).where(F.lit(False))
    # A filter on the hits themselves would be pushed down and would repeat all of the above; one on the exploded rows is not.
    rows = rows.withColumn("hits", F.concat(*found) if len(found) > 1 else found[0])
    rows = rows.withColumn("hit", F.explode_outer("hits")).drop("hits").where(F.col("hit").isNotNull()).withColumn("scale", F.col("hit.scale")).withColumn("at", F.col("hit.at"))
    sizes = F.element_at(F.array(*[F.lit(s[0]) for s in SCALES]), F.col("scale") + 1)
    value = lambda b: F.coalesce(*[F.when(F.col("scale") == s, F.get(f"s{s}_{b}", (F.col("at") / stride).cast("int"))) for s, (_, stride, _) in enumerate(SCALES)])
    values = F.array(*[F.struct(F.lit(b).alias("band"), value(b).alias("value")) for b in range(BANDS)])
    rows = rows.select("doc_id", "sh", "scale", "at", (sizes * BLOCK).alias("len"), F.explode(values).alias("v"))
    right = F.broadcast(bands.select("template", F.col("sh").alias("tsh"), "n", F.col("scale").alias("_s"), F.col("band").alias("_b"), F.col("value").alias("_v")))  # bounded by the list of templates
    rows = rows.join(right, (F.col("scale") == F.col("_s")) & (F.col("v.band") == F.col("_b")) & (F.col("v.value") == F.col("_v")))
    # The text around the window: a template may reach over its ends by its own length.
    start = F.greatest(F.col("at") * BLOCK - F.col("n"), F.lit(0))
    region = F.slice("sh", start + 1, F.col("at") * BLOCK + F.col("len") + F.col("n") - start)
    distinct = F.array_distinct("tsh")
    share = F.size(F.array_intersect(distinct, region)) / F.size(distinct)
    rows = rows.select("doc_id", "template", (F.col("at") * BLOCK).cast("long").alias("at"), share.alias("share")).where(F.col("share") >= containment)
    return rows.groupBy("doc_id", "template").agg(F.max("share").alias("containment"), F.min("at").alias("first_word"), F.countDistinct("at").alias("windows"))
