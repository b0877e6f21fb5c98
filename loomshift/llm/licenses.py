"""License scan by MinHash bands over text windows, with DataFrame functions only.

Texts are lower-cased words. Templates are grouped by length, and each group has overlapping windows of its own length, so
a text that holds a template has a window that agrees with most of it. Windows and templates get `bands`
minimal hashes (bands of one row); a shared one retrieves the template. Then the template's shingles are
looked up in the stretch around the window, and at least `least` of them must be there.

A window that begins within a quarter of a template's length shares at least `least * 3/4` of the template's shingles; with the
shingles of the rest its similarity is at least s = a / (2 - a), a = least * 3/4, and the chance that no band agrees is
(1 - s) ** bands: below 0.001 for 0.8 and 16 bands. Before that, texts without any of the words that at least
`1 - least` of a template's shingles hold are left out: they cannot hold the template.

Texts are cut into stretches of `STRETCH` places with enough words on either side, so every window is seen once and with all
that is around it; stretches without a needed word go at once, and the work grows in proportion to the text.

Defined cases: null and empty texts, and texts shorter than a shingle, hold nothing; templates shorter than a shingle are
one shingle of all their words and are not found in texts; rows that share an id are scanned as one document; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the names and standard notices of well-known licenses
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                         "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                         "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
                         "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
                "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
                "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                          "following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                  "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
TOKEN = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
SIZE = 5
STRETCH = 1024  # window places that are worked on at a time


def tokens(text: str) -> list[str]:
    return re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())


def shingles(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SIZE]) for i in range(max(1, len(words) - SIZE + 1))]


def needed_words(templates: dict[str, str], least: float) -> list[str]:
    """Words of which a text must hold one to hold a template: per template, so many that more than `1 - least` of its shingles have one."""
    wanted = set()
    for text in templates.values():
        own = sorted(set(shingles(tokens(text))))
        miss = math.floor(len(own) * (1 - least) + 1e-9)
        left, hit = set(own), 0
        # long words first, as they are rare in other texts
        for word in sorted({w for s in own for w in s.split()}, key=lambda w: (-len(w), w)):
            if hit > miss:
                break
            of = {s for s in left if word in s.split()}
            if of:
                wanted.add(word)
                hit, left = hit + len(of), left - of
    return sorted(wanted)


def least_hash(values: Column, band: int) -> Column:
    return F.array_min(F.transform(values, lambda v: F.xxhash64(v, F.lit(band))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, bands: int = 16, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """doc_id, license_id, containment (highest part of the template's shingles that a stretch holds) and word (where the first such window begins)."""
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    table = {name: sorted(set(shingles(tokens(text)))) for name, text in templates.items()}
    # groups of templates by number of shingles: 1, 2-3, 4-7, 8-15 ...
    groups = sorted({len(s).bit_length() for s in table.values()})
    longest = {g: max(len(s) for s in table.values() if len(s).bit_length() == g) for g in groups}
    # one row per template: a fixed, small table
    known = spark.createDataFrame([(name, len(s).bit_length(), s) for name, s in table.items()], "license_id string, grp int, own array<string>")
    known = known.withColumn("own", F.transform("own", lambda s: F.xxhash64(s)))
    banded = F.broadcast(known.select("license_id", "grp", "own", F.posexplode(F.array(*[least_hash(F.col("own"), b) for b in range(bands)])).alias("band", "hash")))

    words = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TOKEN), F.lit(0))
    needed = needed_words(templates, least)
    rows = (docs.filter(F.lower(F.col(text_col)).rlike("|".join(re.escape(w) for w in needed)))
            .select(F.col(id_col).alias("doc_id"), words.alias("words")).filter(F.size("words") >= SIZE))
    # bounded stretches of the text, each with all that windows beginning in it can reach on either side
    reach = 3 * max(longest.values()) + 2 * SIZE
    last = F.size("words") - SIZE + 1
    cut = F.transform(F.sequence(F.lit(1), last, F.lit(STRETCH)), lambda at: stretch(at, reach))
    rows = rows.select("doc_id", F.explode(cut).alias("s")).select("doc_id", "s.*")
    rows = rows.withColumn("hits", F.filter(F.transform("words", lambda w, i: F.when(w.isin(needed), i + F.col("begin"))), lambda i: i.isNotNull()))
    rows = rows.filter(F.size("hits") > 0).select(
        "doc_id", "begin", "own", "hits", F.transform(F.sequence(F.lit(1), F.size("words") - SIZE + 1),
                                                      lambda i: F.xxhash64(F.array_join(F.slice("words", i, SIZE), " "))).alias("all"))
    # windows of every group near a needed word: as long as its longest template, beginning a quarter of its shortest apart
    windows = F.flatten(F.array(*[windows_of(g, longest[g]) for g in groups]))
    rows = rows.select("doc_id", F.explode(windows).alias("w")).select("doc_id", "w.*")
    own_window = F.slice("around", F.col("lead") + 1, F.col("size"))
    hashes = F.array(*[least_hash(own_window, b) for b in range(bands)])
    rows = rows.select("doc_id", "grp", "start", "around", F.posexplode(hashes).alias("band", "hash"))
    found = rows.join(banded, ["grp", "band", "hash"])
    held = F.size(F.array_intersect("own", "around")) / F.size("own")
    return (found.withColumn("containment", held).filter(F.col("containment") >= least)
            .groupBy("doc_id", "license_id").agg(F.max("containment").alias("containment"), (F.min("start") - 1).cast("int").alias("word")))


def stretch(at: Column, reach: int) -> Column:
    """The words of the windows that begin at `at` or up to the next stretch, and `reach` words more on both sides; begin is the place of the first."""
    begin = F.greatest(at - reach, F.lit(1))
    return F.struct(at.alias("own"), begin.alias("begin"), F.slice("words", begin, at - begin + STRETCH + reach + SIZE).alias("words"))


def windows_of(group: int, size: int) -> Column:
    """Windows of a group of templates: where they begin, the shingles from a window's length before to one behind, and how
    many of them come before the window.

    The places come from the needed words, some fifteen for each, so the work grows with the text and not with its square.
    """
    step = max(1, (1 << (group - 1)) // 4)
    end = F.least(F.col("own") + STRETCH, F.col("begin") + F.size("all"))

    def places(hit: Column) -> Column:
        # on the grid of the whole text: 1, 1 + step, 1 + 2 * step ...
        low = F.greatest(hit - size - SIZE - step, F.col("own"))
        first = F.ceil((low - 1) / step).cast("int") * step + 1
        high = F.least(hit + step, end - 1)
        return F.when(first <= high, F.sequence(first, high, F.lit(step))).otherwise(F.array().cast("array<int>"))

    def window(start: Column) -> Column:
        at = start - F.col("begin") + 1  # within the stretch
        before = F.greatest(at - size, F.lit(1))
        return F.struct(F.lit(group).alias("grp"), start.alias("start"), F.lit(size).alias("size"), (at - before).alias("lead"),
                        F.slice("all", before, 3 * size).alias("around"))

    return F.transform(F.array_distinct(F.flatten(F.transform("hits", places))), window)
