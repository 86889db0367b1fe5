"""Licence scans with a trained paragraph classifier.

A paragraph is a line of a text with a licence feature, alone or with the lines after it up to an
empty line, as notices are wrapped: the family of the shortest of ``WIDTHS`` that is confirmed counts,
and further lines of that notice are no paragraphs of their own. Its distinct words and word pairs that the classifier knows are
sparse features of a multinomial logistic regression over licence families and an unknown class.
It is trained on the driver from the notices below, written out by rule, and from ordinary and
licence-like sentences of the unknown class, some 400 rows in all, so the training set is bounded
by its constants. A temperature fitted on every fifth row, left out of training, calibrates the
probabilities. A family needs the highest probability, at least ``CERTAIN``, and a notice of the
family of which the paragraph has most word pairs confirms it, if the paragraph also has a pair that
sets the notice apart from each notice much like it (of another version, or of AGPL); what has features but is not
confirmed counts as an unknown licence.

Weights are whole millionths, so sums do not depend on their order. Scoring is one projection of
native functions per row: no shuffle, no Python.

Defined results: a null or empty text has no paragraphs and no families; repeated rows are scanned
each for themselves; extra columns are not read; an empty table gives an empty result. Ties between
families go to the first in order. The work is linear in the text, so long texts do no harm.
"""

import json
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockflow.llm.common import ascii_lower, let, table

# Names of licence families, and the opening sentences of their texts.
NAMES = {
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "BSD-3-Clause"],
    "CC-BY-4.0": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License",
                  "CC-BY-4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0",
                     "Creative Commons Attribution-NonCommercial 4.0 International License",
                     "CC-BY-NC-4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0",
                     "Creative Commons Attribution-ShareAlike 4.0 International License",
                     "CC-BY-SA-4.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero", "CC0-1.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"],
    "ISC": ["ISC License", "ISC license terms", "ISC"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"],
    "MIT": ["MIT License", "MIT license terms", "MIT"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
}
OPENINGS = {
    "Apache-2.0": ["You may obtain a copy of the License at http://www.apache.org/licenses/"
                   "LICENSE-2.0"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without "
                     "modification, are permitted provided that the following conditions are met"],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation, either version 3 of the License, or any later version"],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under "
                "the terms of the GNU General Public License as published by the Free Software "
                "Foundation; either version 2 of the License, or any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"],
    "LGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under "
                 "the terms of the GNU Lesser General Public License as published by the Free "
                 "Software Foundation, either version 3 of the License, or any later version"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, "
                "v. 2.0"],
}
FRAMES = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.",
          "This work is licensed under the {}.", "This work is licensed under a {}.",
          "SPDX-License-Identifier: {}", "Distributed under the terms of the {}.",
          "This project is available under the {}, see the file LICENSE."]
# Licences the classifier is not to know.
OTHERS = ["Foo Public License", "company licence agreement", "proprietary license",
          "end user license agreement", "commercial license", "Vendor Source License, version 5",
          "custom license 7.0", "Artwork License",
          "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"]
OTHER_OPENINGS = [s.replace("Lesser", "Affero") for s in OPENINGS["LGPL-3.0"]] + [
    s.replace("GNU General", f"GNU {kind} General")
    for kind in ("Lesser", "Library") for s in OPENINGS["GPL-2.0"]]
# Sentences and frequent words of ordinary prose; their words are no features.
PROSE = ["all rights reserved", "the a an and or of in on to for by with at from that this is are "
         "was were be been it its as any not no will can may you we they he she which who if or",
         "a new version was released last week under heavy rain",
         "the terms of the agreement are available and the work is under way",
         "any person may obtain a copy of the file for this purpose free of charge",
         "the general public and the foundation use software in source and binary form",
         "der die das und in zu den mit von für ist im dem nicht ein eine als auch",
         "le la les de des et en un une du que qui dans pour par sur pas plus au",
         "el la los las de que y en un una por con para no se su al lo como"]
CERTAIN = 0.6
ALIKE = 0.6      # share of a paragraph's known pairs that stand in one notice
WIDTHS = [1, 2, 3, 4, 6, 9, 16]  # lines of a wrapped notice
RIDGE = 0.02
STEPS = 400
SCALE = 1_000_000
_TOKEN = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def grams(text: str) -> set[str]:
    """Distinct words and word pairs."""
    words = re.findall(_TOKEN, text.lower())
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


def notices() -> list[tuple[str, str]]:
    """(family, sentence) of every notice."""
    return [(family, frame.format(name)) for family, names in NAMES.items() for name in names
            for frame in FRAMES] + [(f, s) for f, rows in OPENINGS.items() for s in rows * 3]


class Classifier:
    """Weights per gram and class in millionths; class 0 is the unknown one."""

    def __init__(self) -> None:
        rows = notices() + [("", frame.format(name)) for name in OTHERS for frame in FRAMES] \
            + [("", s) for s in PROSE] + [("", s) for s in OTHER_OPENINGS * 3]
        prose = set().union(*(grams(s) for s in PROSE))
        self.families = ["", *sorted(NAMES)]
        sets = [grams(s) - prose for _, s in rows]
        # A pair counts when one of its words is a feature, so that words alone show who has any.
        words = {g for s in sets for g in s if " " not in g}
        known = sorted({g for s in sets for g in s if " " not in g
                        or not words.isdisjoint(g.split())})
        at = {g: i for i, g in enumerate(known)}
        x = np.zeros((len(rows), len(known)))
        for row, s in enumerate(sets):
            x[row, [at[g] for g in s if g in at]] = 1
        y = np.eye(len(self.families))[[self.families.index(f) for f, _ in rows]]
        out = np.arange(len(rows)) % 5 == 4
        w, b = np.zeros((len(known), y.shape[1])), np.zeros(y.shape[1])
        for _ in range(STEPS):
            error = self._softmax(x[~out] @ w + b) - y[~out]
            w -= 0.5 * (x[~out].T @ error / (~out).sum() * 10 + RIDGE * w / 10)
            b -= 0.5 * error.mean(axis=0)
        logits = x[out] @ w + b
        temperatures = np.linspace(0.3, 3, 28)
        losses = [-np.log((self._softmax(logits / t) * y[out]).sum(axis=1) + 1e-12).mean()
                  for t in temperatures]
        temperature = temperatures[int(np.argmin(losses))]
        self.words = sorted(words)
        self.weights = {g: [round(v * SCALE / temperature) for v in w[i]]
                        for g, i in at.items()}
        self.bias = [round(v * SCALE / temperature) for v in b]
        pairs = {(f, frozenset(g for g in grams(s) if " " in g)) for f, s in rows
                 if len(s.split()) > 1 and s not in PROSE}
        self.pairs = sorted((f, sorted(own), self._apart(f, own, pairs)) for f, own in pairs if f)

    @staticmethod
    def _apart(family: str, own: frozenset, pairs: set) -> list[list[str]]:
        """Sets of pairs; a paragraph with one of each is not just a notice of another family."""
        sets = {own - other for f, other in pairs
                if f != family and len(own & other) >= ALIKE * len(own)} - {frozenset()}
        return sorted(sorted(x) for x in sets if not any(y < x for y in sets))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


@cache
def classifier() -> Classifier:
    return Classifier()


def _tokens(line: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(line), F.lit(_TOKEN), F.lit(0))


def _constant(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text with a licence feature: family ('' for unknown), probability in
    millionths, share of the best notice, and whether the family is confirmed."""
    model = classifier()
    k = len(model.families)
    weights = _constant(model.weights, "map<string,array<bigint>>")
    notice_pairs = _constant([{"f": f, "p": pairs, "a": apart} for f, pairs, apart in model.pairs],
                             "array<struct<f:string,p:array<string>,a:array<array<string>>>>")
    families = F.array(*(F.lit(f) for f in model.families))
    bias = F.array(*(F.lit(v) for v in model.bias)).cast("array<bigint>")

    def judged(words: Column) -> Column:
        pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                            lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1)))
        return let(F.array_distinct(pairs), lambda p: let(
            F.filter(F.transform(F.concat(F.array_distinct(words), p),
                                 lambda g: F.try_element_at(weights, g)),
                     lambda v: v.isNotNull()),
            lambda found: let(F.aggregate(found, bias, lambda a, v: F.zip_with(
                a, v, lambda x, y: x + y)), lambda z: verdict(z, p))))

    def verdict(z: Column, pairs: Column) -> Column:
        top = F.array_max(z)
        best = F.get(families, F.array_position(z, top).cast("int") - 1)
        total = F.aggregate(z, F.lit(0.0), lambda a, v: a + F.exp((v - top) / SCALE))
        like = F.coalesce(F.array_max(F.transform(
            F.filter(notice_pairs, lambda n: (n["f"] == best) & F.forall(
                n["a"], lambda apart: F.arrays_overlap(apart, pairs))),
            lambda n: F.size(F.array_intersect(n["p"], pairs)) / F.size(n["p"]))), F.lit(0.0))
        return F.struct(best.alias("family"),
                        F.round(F.lit(1.0) / total * SCALE).cast("long").alias("probability"),
                        F.round(like * SCALE).cast("long").alias("alike"))

    def sure(r: Column) -> Column:
        return ((r["family"] != "") & (r["probability"] >= CERTAIN * SCALE)
                & (r["alike"] >= ALIKE * SCALE))

    def entry(i: Column, lines: Column) -> Column:
        """The family of the narrowest confirmed verdict from a line on, as far as more lines make
        it more alike, or else the verdict of the line alone."""
        ahead = F.slice(lines, i + 1, F.lit(WIDTHS[-1]))
        empty = F.array_position(F.transform(ahead, F.size), 0).cast("int")

        def verdicts(run: Column) -> Column:
            wide = F.filter(
                F.array(*(F.struct(F.lit(w).alias("w"), F.lit(before).alias("before"))
                          for w, before in zip(WIDTHS, [0, *WIDTHS], strict=False))),
                lambda x: x["before"] < F.size(run))
            return F.transform(wide, lambda x: F.struct(
                judged(F.flatten(F.slice(run, 1, x["w"]))).alias("r"),
                F.least(x["w"], F.size(run)).alias("w")))

        run = F.when(empty > 0, F.slice(ahead, 1, empty - 1)).otherwise(ahead)

        def widened(v: Column) -> Column:
            good = F.filter(v, lambda x: sure(x["r"]))
            return let(good, lambda g: F.array_max(F.transform(
                F.filter(g, lambda x: x["r"]["family"] == F.get(g, F.lit(0))["r"]["family"]),
                lambda x: F.struct(x["r"]["alike"].alias("alike"), (-x["w"]).alias("less"),
                                   x.alias("x")))))["x"]

        return let(let(run, verdicts), lambda v: let(
            F.coalesce(widened(v), F.get(v, F.lit(0))), lambda x: F.struct(
                x["r"]["family"].alias("family"), x["r"]["probability"].alias("probability"),
                x["r"]["alike"].alias("alike"), sure(x["r"]).alias("confirmed"),
                i.alias("at"), (i + x["w"]).alias("end"))))

    def rest(found: Column) -> Column:
        """Without unconfirmed lines inside a confirmed notice that began before them."""
        most = WIDTHS[-1]
        return F.filter(found, lambda r, j: r["confirmed"] | ~F.exists(
            F.slice(found, F.greatest(j - most + 2, F.lit(1)), F.least(j, F.lit(most - 1))),
            lambda b: b["confirmed"] & (b["end"] > r["at"])))

    split = F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")
    found = let(F.transform(split, _tokens), lambda lines: F.transform(
        F.filter(F.transform(lines, lambda words, i: F.when(
            F.exists(words, lambda w: w.isin(model.words)), i)), lambda i: i.isNotNull()),
        lambda i: entry(i, lines)))
    return F.transform(let(found, rest), lambda r: F.struct(
        *(r[c].alias(c) for c in ("family", "probability", "alike", "confirmed"))))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every document with its licence families."""
    rows = docs.select(*keep, paragraphs(F.col("text")).alias("_p"))
    sure = F.filter("_p", lambda p: p["confirmed"])
    return rows.select(
        *keep, F.size("_p").cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda p: p["family"]))),
                     ",").alias("families"),
        (F.size("_p") - F.size(sure)).cast("long").alias("n_unknown"),
        F.coalesce(F.array_max(F.transform(sure, lambda p: p["probability"])), F.lit(0))
        .alias("probability"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families of every document."""
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op9_licences": op9_licences}
ORACLES: dict[str, str] = {}
