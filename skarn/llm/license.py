r"""Licence scans: a trained paragraph classifier, confirmed by template comparison, in DataFrame functions only.

A document is judged line by line (\n) and, for notices that are wrapped, window by window: a line with the lines below
it up to REACH_WORDS words more, or to a line without words, joined. REACH_WORDS is twice the longest template, so a
template that begins in a line lies whole in that line's window. The words `[a-z0-9.+-]+` of the lower-cased text give
its distinct one- and two-word n-grams; a sparse multinomial logistic regression scores each licence family and the
class `unknown`. A temperature, fitted on held-out rows, calibrates the probabilities; a family needs the wanted
probability. A prediction counts as confirmed when enough of the two-word shingles of one of the family's templates are
in the text. A line without an n-gram of the model is no candidate; all others are scored. A window adds a confirmed
notice only where none of its lines confirms the same family alone; of windows that follow each other and confirm
one family the one with the largest share counts, the last of equal ones: it begins where the notice does.

The model is fitted on the driver on TRAINING_ROWS generated paragraphs with a fixed seed (templates with words
dropped, changed and surrounded by other words; licence talk that names none; plain words) and enters the plan as literals of a
few hundred n-grams. Scoring is one scan: no user function, no shuffle, no join.

Defined cases: null and empty texts have no candidate; repeated rows give a row each; a null doc_id stays null; a
line of any length is scored whole; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINING_ROWS = 4000
#: Further training rows, of plain words.
PLAIN_ROWS = 2000
MIN_PROBABILITY = 0.8
MIN_TEMPLATE_SHARE = 0.6
UNKNOWN = "unknown"
_SPARSE = 2e-3
_MAPS = 256
_WORD = r"[a-z0-9.+-]*[a-z0-9+]"

#: The wording by which licences are named and granted, by family.
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2.0", "spdx-license-identifier apache-2.0", "you may not use this file except in compliance with the license", "apache license version 2.0 january 2004", "released under the apache license 2.0", "apache license", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"),
    "mit": ("released under the mit license", "licensed under the mit license", "spdx-license-identifier mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "the mit license mit", "mit license", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "spdx-license-identifier gpl-3.0-or-later", "it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license for more details", "licensed under the gpl v2 license", "gnu general public license", "free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    "lgpl": ("licensed under the gnu lesser general public license", "spdx-license-identifier lgpl-2.1-only", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    "agpl": ("licensed under the gnu affero general public license version 3", "spdx-license-identifier agpl-3.0-only", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    "bsd": ("licensed under the bsd 3-clause license", "released under the bsd license", "spdx-license-identifier bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice", "bsd 3-clause license", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "this software is provided by the copyright holders and contributors as is and any express or implied warranties"),
    "mpl": ("subject to the terms of the mozilla public license v. 2.0", "licensed under the mozilla public license 2.0", "spdx-license-identifier mpl-2.0", "mozilla public license version 2.0"),
    "isc": ("licensed under the isc license", "spdx-license-identifier isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc license"),
    "cc-by": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license", "spdx-license-identifier cc-by-4.0", "available under the creative commons attribution license"),
    "cc-by-sa": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license", "spdx-license-identifier cc-by-sa-4.0", "text is available under the creative commons attribution-sharealike license"),
    "cc-by-nc": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license", "spdx-license-identifier cc-by-nc-4.0", "available under the creative commons attribution-noncommercial license"),
    "cc-by-nd": ("licensed under cc by-nd 4.0", "this work is licensed under a creative commons attribution-noderivatives 4.0 international license", "spdx-license-identifier cc-by-nd-4.0"),
    "cc0": ("released under cc0 1.0", "cc0 1.0 universal public domain dedication", "this work is dedicated to the public domain under cc0", "spdx-license-identifier cc0-1.0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "spdx-license-identifier unlicense", "released under the unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    "proprietary": ("all rights reserved no part of this work may be reproduced without permission", "proprietary and confidential all rights reserved", "copyright all rights reserved", "licensed under a commercial license agreement"),
}
#: Talk about licences and copies that grants nothing.
OTHER = (
    "his driving license expired last year", "a fishing license is sold at the lake", "the license plate of the car", "she got her pilot license in may", "poetic license was taken here",
    "the shop has a liquor license", "the warranty covers two years", "warranted by the facts", "an arrest warrant was issued", "the copyright debate goes on in court",
    "licensed taxi drivers only", "the licensing board met today", "permission is hereby refused", "a public domain of interest", "redistribution of wealth", "a licensed nurse under the care of the clinic",
    "the gnu is a large antelope", "license fees rose by version", "licensed under pressure", "released under the radar license", "please read the license", "see the license for details", "work licensed by the state",
)
#: Twice the words of the longest template.
REACH_WORDS = 2 * max(len(t.split()) for ts in TEMPLATES.values() for t in ts)
FAMILIES = tuple(TEMPLATES)
CLASSES = (UNKNOWN, *FAMILIES)


def grams_of(text: str) -> list[str]:
    """The distinct n-grams of a paragraph, as the projection has them."""
    words = re.findall(_WORD, text.lower())
    return list(dict.fromkeys(words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]))


def _filler(rng: random.Random) -> str:
    return "".join(rng.choice(["th", "er", "on", "an", "re", "in", "la", "que", "ch", "ung", "o", "a", "the ", "of ", "and "]) for _ in range(rng.randint(1, 4))).strip()


def examples(n: int, seed: int) -> list[tuple[str, int]]:
    """Generated paragraphs with their class."""
    rng, rows = random.Random(seed), []
    while len(rows) < n:
        k = rng.randrange(len(CLASSES) + 4)
        k = 0 if k >= len(CLASSES) else k
        words = rng.choice(OTHER if k == 0 else TEMPLATES[CLASSES[k]]).split()
        if k == 0 and rng.random() < 0.4:  # a grant that names no family the model has
            words = rng.choice(["licensed under the", "released under the", "this work is licensed under the", "spdx-license-identifier"]).split() + [_filler(rng)] + rng.choice([["license"], ["licence"], [], ["public", "license"], ["license", "version", "2.0"]])
        elif len(words) > 9 and rng.random() < 0.5:
            words = [w for w in words if rng.random() > 0.08]
        if rng.random() < 0.2:
            words = [w.replace("license", "licence") for w in words]
        around = rng.choice([0, 0, 3, 8])
        words = [_filler(rng) for _ in range(rng.randint(0, around))] + words + [_filler(rng) for _ in range(rng.randint(0, around))]
        rows.append((" ".join(words).capitalize() + rng.choice([".", "", ","]), k))
    return rows


def plain_words(n: int, seed: int) -> list[tuple[str, int]]:
    """Paragraphs of other words among which single words of the templates stand by chance: unknown."""
    rng, rows = random.Random(seed), []
    known = sorted({w for ts in TEMPLATES.values() for t in ts for w in t.split()})
    for _ in range(n):
        words = [_filler(rng) for _ in range(rng.randint(3, 30))]
        for w in rng.sample(known, rng.randint(1, 3)):
            words.insert(rng.randrange(len(words) + 1), w)
        rows.append((" ".join(words).capitalize() + ".", 0))
    return rows


@dataclass
class Model:
    weights: dict[str, list[float]]
    bias: list[float]
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        """For tests: the same sums on the driver."""
        return np.sum([self.bias, *(self.weights[g] for g in grams_of(text) if g in self.weights)], axis=0)


@lru_cache(maxsize=1)
def model(seed: int = 5) -> Model:
    """Proximal gradient descent with an L1 term; the temperature is the best of a grid on held-out rows."""
    rows = examples(TRAINING_ROWS, seed) + plain_words(PLAIN_ROWS, seed)
    random.Random(seed).shuffle(rows)
    fit, held = rows[: len(rows) * 3 // 4], rows[len(rows) * 3 // 4 :]
    counts: dict[str, int] = {}
    for text, _ in fit:
        for g in grams_of(text):
            counts[g] = counts.get(g, 0) + 1
    known = {w for t in (*OTHER, *(x for v in TEMPLATES.values() for x in v)) for w in (t.split() + t.replace("license", "licence").split())}
    vocabulary = sorted(g for g, n in counts.items() if n >= 5 and set(g.split(" ")) <= known)
    at = {g: i for i, g in enumerate(vocabulary)}

    def matrix(part):
        x = np.zeros((len(part), len(vocabulary)))
        for r, (text, _) in enumerate(part):
            x[r, [at[g] for g in grams_of(text) if g in at]] = 1
        return x, np.array([k for _, k in part])

    x, y = matrix(fit)
    target = np.eye(len(CLASSES))[y]
    w, b = np.zeros((len(vocabulary), len(CLASSES))), np.zeros(len(CLASSES))
    rate = 4.0
    for _ in range(300):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        grad = (p - target) / len(y)
        w -= rate * (x.T @ grad)
        b -= rate * 0.2 * grad.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * _SPARSE * 0.1, 0)
    hx, hy = matrix(held)
    z = hx @ w + b

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) - (s - s.max(axis=1, keepdims=True))[np.arange(len(hy)), hy]))

    temperature = min(np.linspace(0.3, 3, 28), key=loss)
    used = np.flatnonzero(np.abs(w).sum(axis=1) > 1e-3)
    return Model({vocabulary[i]: [round(float(v), 4) for v in w[i]] for i in used}, [round(float(v), 4) for v in b], float(temperature))


def _grams(words: Column) -> Column:
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)


def _array(values, kind: str) -> Column:
    return F.array(*(F.lit(v) for v in values)).cast(f"array<{kind}>")


def paragraphs(documents: DataFrame) -> DataFrame:
    """doc_id, found: for each line with a feature, then for each wrapped notice, its line, text, family, probability and confirmation."""
    fitted = model()
    dealt: list[dict] = [{} for _ in range(_MAPS)]  # a map is searched from end to end, so many small ones
    for g, v in fitted.weights.items():
        dealt[zlib.crc32(g.encode()) % _MAPS][g] = v
    weights = F.array(*(F.map_from_arrays(_array(m, "string"), F.array(*(_array(v, "double") for v in m.values())).cast("array<array<double>>")) for m in dealt))
    bias, classes = _array(fitted.bias, "double"), _array(CLASSES, "string")
    pairs_of = {f: [[g for g in grams_of(t) if " " in g] for t in ts] for f, ts in TEMPLATES.items()}
    templates = F.array(*(F.struct(F.lit(f).alias("family"), _array(pairs, "string").alias("pairs")) for f, ts in pairs_of.items() for pairs in ts))
    every = _array(dict.fromkeys(g for ts in pairs_of.values() for pairs in ts for g in pairs), "string")
    wanted = _array(dict.fromkeys([*fitted.weights, *(g for ts in pairs_of.values() for pairs in ts for g in pairs)]), "string")

    def bound(value: Column, use) -> Column:
        """use(value), with value computed once."""
        return F.element_at(F.transform(F.array(value), use), 1)

    def share(grams: Column, family: Column) -> Column:
        """The largest part of a template of the family that is there."""
        own = F.filter(templates, lambda t: t["family"] == family)
        return F.coalesce(F.array_max(F.transform(own, lambda t: F.size(F.array_intersect(t["pairs"], grams)) / F.size(t["pairs"]))), F.lit(0.0))

    def near(grams: Column) -> Column:
        """Whether enough of any template is there; only then can a family be confirmed."""

        def enough(pairs):
            return F.exists(templates, lambda t: F.size(F.array_intersect(t["pairs"], pairs)) >= F.size(t["pairs"]) * MIN_TEMPLATE_SHARE)

        return bound(F.filter(grams, lambda g: g.contains(" ")), lambda pairs: bound(F.array_intersect(pairs, every), lambda own: (F.size(own) > 0) & enough(own)))

    def judged(grams: Column) -> Column:
        """family, probability, the template's share and whether the n-grams have a feature of the model."""

        def by_grams(grams):
            known = F.filter(F.transform(grams, lambda g: F.element_at(F.get(weights, (F.crc32(g.cast("binary")) % _MAPS).cast("int")), g)), lambda w: w.isNotNull())
            logits = F.aggregate(known, bias, lambda acc, w: F.zip_with(acc, w, lambda a, b: a + b))

            def by_logits(z):
                top = F.array_max(z)
                total = F.aggregate(z, F.lit(0.0), lambda acc, v: acc + F.exp((v - top) / fitted.temperature))
                likely = F.struct((1 / total).alias("p"), F.element_at(classes, F.array_position(z, top).cast("int")).alias("family"))

                def by_likely(x):
                    known = (x["p"] >= MIN_PROBABILITY) & (x["family"] != UNKNOWN)
                    return F.struct(F.when(known, x["family"]).otherwise(UNKNOWN).alias("family"), x["p"].alias("probability"), F.when(known, share(grams, x["family"])).otherwise(0.0).alias("share"), (z != bias).alias("featured"))

                return bound(likely, by_likely)

            return bound(logits, by_logits)

        return bound(grams, by_grams)

    def tokens(text: Column) -> Column:
        """Of a line: the count of its words, its first and last word and its distinct n-grams that a model or template has."""
        words = F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"), 1)
        return bound(words, lambda w: F.struct(F.size(w).alias("size"), F.get(w, F.lit(0)).alias("head"), F.get(w, F.size(w) - 1).alias("tail"), F.array_intersect(_grams(w), wanted).alias("grams")))

    def window(line: Column) -> Column:
        """grams, n: the n-grams of a line joined with those below it, as far as its window goes, and how many lines these are."""
        own = F.get("tokens", line)
        start = F.struct(own["grams"].alias("grams"), own["tail"].alias("tail"), F.lit(1).alias("n"), F.lit(0).alias("below"), F.lit(False).alias("over"))

        def add(acc, more):
            over = acc["over"] | (more["size"] == 0) | (acc["below"] >= REACH_WORDS)
            grams = F.concat(acc["grams"], F.array(F.concat(acc["tail"], F.lit(" "), more["head"])), more["grams"])
            return F.when(over, F.struct(acc["grams"].alias("grams"), acc["tail"].alias("tail"), acc["n"].alias("n"), acc["below"].alias("below"), F.lit(True).alias("over"))).otherwise(
                F.struct(grams.alias("grams"), more["tail"].alias("tail"), (acc["n"] + 1).alias("n"), (acc["below"] + more["size"]).alias("below"), F.lit(False).alias("over"))
            )

        size = lambda k: F.coalesce(F.get("tokens", line + k)["size"], F.lit(0))
        lines = F.when((size(1) >= REACH_WORDS) | (size(2) == 0), 1).when((size(1) + size(2) >= REACH_WORDS) | (size(3) == 0), 2).otherwise(REACH_WORDS)  # so many at most
        return F.aggregate(F.slice("tokens", line + 2, lines), start, add)

    def wrapped(line: Column) -> Column:
        """n, judged: of a line's window, null for a window of that line alone."""
        several = (F.get("tokens", line)["size"] > 0) & (F.coalesce(F.get("tokens", line + 1)["size"], F.lit(0)) > 0)
        return F.when(several, bound(window(line), lambda w: F.when(near(w["grams"]), F.struct(w["n"].alias("n"), judged(F.array_distinct(w["grams"])).alias("judged")))))

    def kept(line: Column, w: Column) -> Column:
        own = w["judged"]

        def same(x):
            return F.coalesce((x["share"] >= MIN_TEMPLATE_SHARE) & (x["family"] == own["family"]), F.lit(False))

        above, below = F.get("windows", line - 1)["judged"], F.get("windows", line + 1)["judged"]
        alone = F.exists(F.slice("judged", line + 1, w["n"]), same)
        return F.coalesce(same(own) & ~alone & ~(same(below) & (below["share"] >= own["share"])) & ~(same(above) & (above["share"] > own["share"])), F.lit(False))

    def entry(line: Column, text: Column, x: Column) -> Column:
        return F.struct(line.alias("line"), text.alias("text"), x["family"].alias("family"), x["probability"].alias("probability"), (x["share"] >= MIN_TEMPLATE_SHARE).alias("confirmed"))

    base = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n").alias("lines"))
    split = base.select("doc_id", "lines", F.transform("lines", tokens).alias("tokens"))
    single = split.select("*", F.transform("tokens", lambda t: judged(t["grams"])).alias("judged"))
    whole = single.select("*", F.transform("tokens", lambda _, i: wrapped(i)).alias("windows"))
    ones = F.filter(F.transform("judged", lambda x, i: F.when(x["featured"], entry(i, F.get("lines", i), x))), lambda x: x.isNotNull())
    more = F.filter(F.transform("windows", lambda w, i: F.when(kept(i, w), entry(i, F.array_join(F.slice("lines", i + 1, w["n"]), "\n"), w["judged"]))), lambda x: x.isNotNull())
    return whole.select("doc_id", F.concat(ones, more).alias("found"))


def scan(documents: DataFrame) -> DataFrame:
    """A row per row of documents: doc_id, n_candidates, n_licences, families (confirmed, sorted), first_line, n_unconfirmed."""
    sure = F.filter("found", lambda x: (x["family"] != UNKNOWN) & x["confirmed"])
    unsure = F.filter("found", lambda x: (x["family"] != UNKNOWN) & ~x["confirmed"])
    return paragraphs(documents).select(
        "doc_id",
        F.size("found").cast("long").alias("n_candidates"),
        F.size(sure).cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.coalesce(F.array_min(F.transform(sure, lambda x: x["line"])), F.lit(-1)).cast("long").alias("first_line"),
        F.size(unsure).cast("long").alias("n_unconfirmed"),
    )


def brute_force(text: str | None) -> tuple[int, int, str, int, int]:
    """For tests: what scan has of one text, line by line in plain Python."""
    fitted, pairs_of = model(), {f: [[g for g in grams_of(t) if " " in g] for t in ts] for f, ts in TEMPLATES.items()}

    def judged(own: str) -> tuple[str, float, bool]:
        grams = grams_of(own)
        z = fitted.logits(own) / fitted.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        family = CLASSES[int(p.argmax())]
        if p.max() < MIN_PROBABILITY or family == UNKNOWN:
            return UNKNOWN, 0.0, any(g in fitted.weights for g in grams)
        return family, max(sum(g in grams for g in pairs) / len(pairs) for pairs in pairs_of[family]), True

    lines = (text or "").split("\n")
    words = [re.findall(_WORD, line.lower()) for line in lines]
    singles, windows = [judged(line) for line in lines], []
    for i in range(len(lines)):
        end, below = i + 1, 0
        while words[i] and end < len(lines) and words[end] and below < REACH_WORDS:
            below += len(words[end])
            end += 1
        windows.append((end - i, judged(" ".join(w for own in words[i:end] for w in own))) if end > i + 1 else None)
    same = lambda x, family: x[0] == family and x[1] >= MIN_TEMPLATE_SHARE
    found = [(i, family, share >= MIN_TEMPLATE_SHARE) for i, (family, share, featured) in enumerate(singles) if featured]
    for i, w in enumerate(windows):
        if w and same(w[1], w[1][0]) and not any(same(x, w[1][0]) for x in singles[i : i + w[0]]):
            after, before = windows[i + 1 : i + 2], windows[max(0, i - 1) : i]
            if not any(x and same(x[1], w[1][0]) and x[1][1] >= w[1][1] for x in after) and not any(x and same(x[1], w[1][0]) and x[1][1] > w[1][1] for x in before):
                found.append((i, w[1][0], True))
    sure = [(i, f) for i, f, confirmed in found if f != UNKNOWN and confirmed]
    return len(found), len(sure), ",".join(sorted({f for _, f in sure})), min((i for i, _ in sure), default=-1), sum(f != UNKNOWN and not c for _, f, c in found)
