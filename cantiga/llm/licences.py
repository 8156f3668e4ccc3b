"""Licence scans with DataFrame functions alone.

A paragraph is a line. A multinomial logistic regression over the 1- to 3-word n-grams of licence notices tells the family, or
that it is unknown; it is fitted on the driver, in plain Python, from the notices and counter-examples below, and its
temperature is set on rows left out of the fit. A prediction is confirmed when the paragraph holds most n-grams of one
of that family's templates. Scoring is a projection: no shuffle, no join, weights as literals of the plan.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import documents

UNKNOWN = "unknown"
#: The least probability of a family, and the least share of a template's n-grams.
CERTAIN, CONFIRM = 0.5, 0.6

TEMPLATES = {
    "apache": ("Licensed under the Apache License, Version 2.0.", "Apache-2.0 license", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    "mit": ("Released under the MIT License.", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3.", "GNU GPL v3 or later", "you can redistribute it and/or modify it under the terms of the GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"),
    "bsd": ("BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License"),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International License"),
    "cc0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal", "This work is in the public domain."),
    "reserved": ("All rights reserved.", "Copyright (c) 2020 Example Corp. All rights reserved."),
}
#: Notices in other words, for fitting alone.
VARIANTS = {
    "apache": ("This project is licensed under the Apache License 2.0", "distributed under the Apache License, Version 2.0", "code is available under Apache-2.0"),
    "mit": ("This software is licensed under the MIT license", "licensed under MIT", "distributed under the terms of the MIT License"),
    "gpl": ("This program is free software under the GNU General Public License", "licensed under GPL-3.0", "released under the GNU GPL version 3", "licensed under the GNU General Public License v2"),
    "bsd": ("licensed under the BSD license", "This code is released under the 2-Clause BSD License", "released under the BSD 3-Clause License"),
    "mpl": ("licensed under the Mozilla Public License 2.0", "released under MPL-2.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial license", "available under CC BY-NC 3.0", "released under CC BY-NC 4.0"),
    "cc-by-sa": ("text is available under the Creative Commons Attribution-ShareAlike license", "released under CC BY-SA 3.0"),
    "cc-by": ("This article is licensed under a Creative Commons Attribution license", "open access under CC BY 4.0", "released under CC BY 4.0"),
    "cc0": ("released into the public domain", "available under CC0", "the author waives all rights under CC0 1.0"),
    "reserved": ("Copyright 2019 the authors, all rights reserved", "all rights reserved worldwide", "no part may be reproduced, all rights reserved"),
}
COUNTER = (
    "the driver showed a license at the gate", "her rights were reserved for the council", "a general meeting was open to the public", "the public library is free of charge",
    "version 3 of the plan was released in May", "permission to enter was granted by the owner", "the source of the river and its form", "the school is licensed to serve food",
    "a table was reserved under the name of Smith", "the common good and the creative arts", "all the rights of the people", "work is done under the bridge", "the terms of the treaty were clear",
    "commercial flights start at 4.0 euros", "the attribution of the painting is unsure", "the apache lived in the south west", "students at MIT build robots", "a copy of the book was obtained",
    "this file is used for the tax office", "copyright law is taught at the university", "domain names are public", "the software was free", "you may use the door", "a binary star with two forms",
    "international trade and universal values", "the mozilla browser is popular", "she can modify the recipe", "the clause was struck from the contract", "any person may apply", "in compliance with the rules",
)
#: Every notice above holds one of these. They leave nothing out of a scan: it looks at all that has a word of `vocabulary`.
KEYS = ("licen", "rights reserved", "public domain", "creative commons", "copyright", "gpl", "cc0", "cc by", "permission is hereby", "redistribut", "apache-2.0", "mpl-2.0", "bsd")
STOP = frozenset("a an and any are as at be by can do for form free from had has have in into is it its may no not of on one only or part start terms that the this to two under use used was were with without you".split())
_WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def grams_of(text: str) -> list[str]:
    """The distinct 1- to 3-word n-grams of a paragraph."""
    w = re.findall(_WORD, text.lower())
    return list(dict.fromkeys(" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)))


def _plain(gram: str) -> bool:
    return all(w in STOP or w.isdigit() for w in gram.split())


@lru_cache(1)
def vocabulary() -> tuple[str, ...]:
    """The n-grams of notices, but those of common words alone."""
    notices = [t for source in (TEMPLATES, VARIANTS) for ts in source.values() for t in ts]
    return tuple(sorted({g for t in notices for g in grams_of(t) if not _plain(g)}))


FAMILIES = (*TEMPLATES, UNKNOWN)


def _fit(rows: list[tuple[list[str], int]], steps: int = 60, rate: float = 1.0) -> tuple[dict[str, list[float]], list[float]]:
    k = len(FAMILIES)
    weight: dict[str, list[float]] = defaultdict(lambda: [0.0] * k)
    bias = [0.0] * (k - 1) + [3.0]  # a paragraph without any of the n-grams is unknown
    for step in range(steps):
        for grams, label in rows:
            p = _shares([bias[c] + sum(weight[g][c] for g in grams) for c in range(k)])
            for c in range(k):
                d = rate / (1 + step / 20) * ((c == label) - p[c]) / max(4, len(grams))
                if abs(d) > 1e-6:
                    for g in grams:
                        weight[g][c] += d
    return dict(weight), bias


def _shares(scores: list[float]) -> list[float]:
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


@lru_cache(1)
def model() -> tuple[dict[str, list[float]], list[float], float]:
    """Weights by n-gram, biases, and the temperature under which rows left out are likeliest."""
    known = set(vocabulary())
    texts = [(t, f) for source in (TEMPLATES, VARIANTS) for f, ts in source.items() for t in ts] + [(t, UNKNOWN) for t in COUNTER]
    rows = [([g for g in grams_of(t) if g in known], FAMILIES.index(f)) for t, f in texts]
    left_out = []
    for fold in range(3):
        weight, bias = _fit([r for i, r in enumerate(rows) if i % 3 != fold])
        for grams, label in rows[fold::3]:
            left_out.append(([bias[c] + sum(weight[g][c] for g in grams if g in weight) for c in range(len(bias))], label))
    loss = {t: -sum(math.log(_shares([s / t for s in scores])[label] + 1e-12) for scores, label in left_out) for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0)}
    return *_fit(rows), min(loss, key=loss.get)


def _list(values) -> Column:
    return F.array(*map(F.lit, values))


def grams_column(text: Column) -> Column:
    """`grams_of` as an expression."""

    def several(w: Column, n: int) -> Column:
        return F.transform(F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array().cast("array<int>")), lambda i: F.concat_ws(" ", F.slice(w, i, n)))

    # the words are the variable of a function, as an expression inside one is computed again for each element
    words = F.array(F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), F.lit(1)))
    return F.element_at(F.transform(words, lambda w: F.array_distinct(F.concat(w, several(w, 2), several(w, 3)))), 1)


def any_of(words: list[str]) -> str:
    """A regular expression of any of the words, branching letter by letter, so that few are tried at a place."""
    if len(words) == 1:
        return re.escape(words[0])
    first = defaultdict(list)
    for w in words:
        first[w[:1]].append(w[1:])
    return "(?:" + "|".join(re.escape(c) + any_of(rest) if c else "" for c, rest in sorted(first.items(), reverse=True)) + ")"


def scan(documents: DataFrame) -> DataFrame:
    """One row per paragraph of a known family: (doc_id, paragraph, family, probability, template_share, confirmed, text).

    paragraph counts the lines of a text from 0. Null, empty and word-less texts have no rows, nor has an empty table; repeated
    rows have each their own. Columns but doc_id and text are not read.
    """
    weight, bias, temperature = model()
    words = vocabulary()

    def once(df: DataFrame, name: str, value: Column) -> DataFrame:
        """Adds a column that later filters and columns use without computing it again."""
        return df.withColumn(name, F.explode(F.array(value)))

    # an n-gram of the vocabulary has a word of the vocabulary, and without any the bias says unknown
    single = [g for g in words if " " not in g]
    likely = f"(?<![a-z0-9]){any_of(single)}(?![a-z0-9])"
    few = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("paragraph", "text"))
    few = few.where(F.lower("text").rlike(likely))
    few = once(few, "grams", grams_column(F.col("text")))
    few = once(few, "known", F.array_intersect("grams", _list(words))).where(F.size("known") > 0)
    table = F.create_map(*(x for g in words for x in (F.lit(g), _list(weight.get(g, [0.0] * len(FAMILIES))))))
    sums = F.aggregate("known", _list(bias), lambda sums, g: F.zip_with(sums, F.element_at(table, g), lambda a, b: a + b))
    few = once(few, "scores", F.transform(sums, lambda s: s / temperature))
    few = once(few, "top", F.array_max("scores"))
    few = once(few, "family", F.element_at(_list(FAMILIES), F.array_position("scores", F.col("top")).cast("int")))
    few = once(few, "probability", 1 / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top"))))
    few = few.where((F.col("family") != UNKNOWN) & (F.col("probability") >= CERTAIN))
    share = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        held = [F.size(F.array_intersect("grams", _list(grams_of(t)))) / len(grams_of(t)) for t in templates]
        share = F.when(F.col("family") == family, F.greatest(*held) if len(held) > 1 else held[0]).otherwise(share)
    few = once(few, "template_share", share)
    return few.select("doc_id", "paragraph", "family", "probability", "template_share", (F.col("template_share") >= CONFIRM).alias("confirmed"), "text")


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
