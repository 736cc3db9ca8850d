"""Operator 5: licence scan by the Dice coefficient over word bigrams, in DataFrame functions alone.

The units compared are every line of a text and, where it has several lines, the whole text; then runs of words across
line breaks and inside lines (license_runs), for texts that are wrapped or share a line with other words. A unit is normalised (A-Z to
lower case, every run of other characters than a-z and 0-9 to one space) and its set of word bigrams is compared with
those of the licence templates: 2 * common / (unit's + template's) >= least. Two bounds, both exact, keep this cheap:
  * size: the coefficient can only reach `least` if the sizes differ by no more than a factor of (2 - least) / least, so a
    template is a candidate only for units of such a size;
  * anchors: a match shares at least least * size / (2 - least) of a template's bigrams, so a unit without any of a few
    words (see anchors) matches nothing. Texts, and then lines, without an anchor leave by substring tests before
    anything is split.
The templates travel as literals of the plan. No shuffle but the final map-side combined aggregation by text and licence.

Defined results: a null or empty text matches nothing and yields no row, nor do units of fewer than two words. Repeated
rows add to the counts of their doc_id; a null doc_id is a group of its own. Texts are scanned whole.
"""

from __future__ import annotations

import re
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from martflow.llm.shared import table

LEAST = 0.8
#: Wordings of public licences and of the notices that name them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
           "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
           "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
           "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
           "in all copies or substantial portions of the Software.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
                  "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                  "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                  "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                  "permissions and limitations under the License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
               "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
                    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                    "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
                    "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
                    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
                    "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                    "promote products derived from this software without specific prior written permission.",
    "lgpl-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
                "License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later "
                "version.",
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                "version.",
    "cc0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
               "software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy "
               "of the CC0 Public Domain Dedication along with this software.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any "
            "damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including "
            "commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is "
               "available at https://www.eclipse.org/legal/epl-2.0/",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
               "with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
                 "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial "
                 "or non-commercial, and by any means.",
}


def bigrams(text: str) -> set[str]:
    """What the expressions below compute, for one text."""
    words = re.sub(r"[^a-z0-9]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def anchors(sets: list[set[str]], least: float, long: int = 6) -> tuple[list[str], list[str]]:
    """(words, bigrams) such that every unit with a coefficient of `least` or more to one of sets holds one of them.

    A match to a template of n bigrams shares ceil(least * n / (2 - least)) of them, so it holds one of any n + 1 less that
    many. Words of `long` letters or more stand for the bigrams that they occur in, those first that serve most templates;
    where they do not reach, bigrams stand for themselves.
    """
    lacking = [len(g) + 1 - ceil(least * len(g) / (2 - least) - 1e-9) for g in sets]
    free = [set(g) for g in sets]
    words, grams = [], []
    candidates = sorted({w for g in sets for x in g for w in x.split() if len(w) >= long}, key=lambda w: (-len(w), w))
    while any(n > 0 for n in lacking):
        gain = {w: sum(min(n, sum(w in x for x in f)) for f, n in zip(free, lacking) if n > 0) for w in candidates}
        best = max(candidates, key=lambda w: gain[w], default=None)
        if best is None or not gain[best]:
            break
        words.append(best)
        for i, f in enumerate(free):
            hit = {x for x in f if best in x}
            free[i], lacking[i] = f - hit, lacking[i] - len(hit)
    for f, n in zip(free, lacking):
        grams += sorted(f, key=lambda x: (-len(x), x))[: max(n, 0)]
    return words, sorted(set(grams))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _any(c: Column, words: list[str], grams: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    if grams:
        out = out | F.rlike(c, F.lit("|".join("[^a-z0-9]+".join(map(re.escape, g.split())) for g in grams)))
    return out


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, place, license, dice): every unit of docs that matches a template. unit: line (place: its number from 1) or text."""
    sets = {name: sorted(bigrams(t)) for name, t in templates.items()}
    sets = {name: g for name, g in sets.items() if g}
    held = anchors([set(g) for g in sets.values()], least)
    ratio = (2 - least) / least
    most = max((len(g) for g in sets.values()), default=0) * ratio
    known = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for name, g in sets.items()])
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    # explode of one value: Catalyst does not pull the generated column into the tests, so a text is lowered once
    rows = rows.withColumn("low", F.explode(F.array(F.lower("t")))).filter(_any(F.col("low"), *held)).select("key", _lower(F.col("t")).alias("low"))
    unit = lambda name, place, body: F.struct(F.lit(name).alias("unit"), place.cast("int").alias("place"), body.alias("body"))
    lines = F.filter(F.transform(F.split("low", "\n"), lambda x, i: unit("line", i + 1, x)), lambda u: _any(u["body"], *held))
    whole = F.when(
        F.contains("low", F.lit("\n")), F.array(unit("text", F.lit(0), F.col("low")))
    ).otherwise(F.array().cast("array<struct<unit:string,place:int,body:string>>"))
    units = rows.select("key", F.explode(F.concat(lines, whole)).alias("u")).select("key", "u.unit", "u.place", "u.body")
    # a whole text of more distinct bigrams than any template allows is not one; most texts end here
    units = units.withColumn("words", F.split(F.trim(F.regexp_replace("body", "[^a-z0-9]+", " ")), " ")).drop("body").filter(F.size("words") > 1)
    pairs = F.zip_with(
        F.slice("words", F.lit(1), F.size("words") - 1), F.slice("words", F.lit(2), F.size("words") - 1), lambda a,
        b: F.concat(a, F.lit(" "), b)
    )
    found = units.withColumn("grams", F.array_distinct(pairs)).withColumn("n", F.size("grams")).filter(F.col("n") <= most)
    fit = F.filter(known, lambda t: (t["n"] <= F.col("n") * ratio + 1e-9) & (F.col("n") <= t["n"] * ratio + 1e-9))
    pruned = found.select("key", "unit", "place", "grams", "n", F.explode(fit).alias("t"))
    dice = F.lit(2.0) * F.size(F.array_intersect("grams", F.col("t.grams"))) / (F.col("n") + F.col("t.n"))
    return pruned.select(
        F.col("key").alias(key), "unit", "place", F.col("t.license").alias("license"), dice.alias("dice")
    ).filter(F.col("dice") >= least - 1e-9)


def _grams(words: Column) -> Column:
    """The bigrams of an array of words, in order."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(words) - 1), F.slice(words, F.lit(2), F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def license_runs(docs: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, place, license, dice): the runs of words that match a template where no unit of license_matches does.

    A run begins and ends with a bigram of the template (others at its ends only lower the coefficient) and has at most
    (2 - least) / least times the template's bigrams. The best run of a text is taken, then the best that shares no word
    with those taken, and so on. Words of a line that matches the same template are taken already, and those of a text
    that matches as a whole. unit: run; place: the number of its first word in the text, from 1.
    """
    sets = {name: sorted(g) for name, t in templates.items() if (g := bigrams(t))}
    ratio = (2 - least) / least
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    rows = rows.withColumn("low", F.explode(F.array(F.lower("t")))).filter(
        _any(F.col("low"), *anchors([set(g) for g in sets.values()], least))
    ).select("key", _lower(F.col("t")).alias("low"))
    lines = F.transform(F.split("low", "\n"), lambda x: F.filter(F.split(F.regexp_replace(x, "[^a-z0-9]+", " "), " "), lambda w: w != ""))
    rows = rows.select("key", F.explode(F.array(lines)).alias("lines")).select("key", "lines", F.explode(F.array(F.flatten("lines"))).alias("words"))
    rows = rows.filter(F.size("words") > 1).select("key", "lines", F.explode(F.array(_grams(F.col("words")))).alias("grams"))
    known = F.array(
        *[
            F.struct(
                F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.lit(ceil(len(g) / ratio - 1e-9)).alias("need"),
                F.lit(int(len(g) * ratio + 1e-9)).alias("most"), F.array(*map(F.lit, g)).alias("grams")
            ) for name,
            g in sets.items()
        ]
    )
    # a match shares `need` bigrams with the template, so the text as a whole does
    rows = rows.select("key", "lines", "grams", F.explode(F.filter(known, lambda t: F.size(F.array_intersect(t["grams"], "grams")) >= t["need"])).alias("t"))

    def dice(grams: Column) -> Column:
        own = F.array_distinct(grams)
        return F.lit(2.0) * F.size(F.array_intersect(own, F.col("t.grams"))) / (F.size(own) + F.col("t.n"))

    rows = rows.filter((F.size("lines") < 2) | (dice(F.col("grams")) < least - 1e-9))
    span = "struct<first:int,last:int>"
    walked = lambda acc, w: F.struct(
        (acc["at"] + F.size(w)).alias("at"),
        F.when(
            dice(_grams(w)) >= least - 1e-9,
            F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("first"), (acc["at"] + F.size(w) - 1).alias("last"))))
        ).otherwise(acc["spans"]).alias("spans"),
    )
    spans = F.aggregate("lines", F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{span}>").alias("spans")), walked, lambda acc: acc["spans"])
    rows = rows.select("key", "grams", "t", F.explode(F.array(spans)).alias("spans"))
    free = lambda first, last: ~F.exists("spans", lambda s: (first <= s["last"]) & (last >= s["first"]))
    hits = F.filter(
        F.transform("grams", lambda x, i: F.struct((i + 1).alias("at"), x.alias("gram"))),
        lambda h: F.array_contains(F.col("t.grams"), h["gram"]) & free(h["at"], h["at"] + 1)
    )
    rows = rows.withColumn("hits", F.explode(F.array(hits))).filter(F.size("hits") >= F.col("t.need"))
    at = lambda i: F.get("hits", i - 1)["at"]
    common = lambda i, n: F.size(F.array_distinct(F.transform(F.slice("hits", i, n), lambda h: h["gram"])))
    starts = F.filter(F.sequence(F.lit(1), F.size("hits") - F.col("t.need") + 1), lambda a: common(a, F.col("t.most")) >= F.col("t.need"))
    ends = lambda a: F.filter(
        F.sequence(a + F.col("t.need") - 1, F.least(F.size("hits"), a + F.col("t.most") - 1)),
        lambda b: (at(b) - at(a) < F.col("t.most")) & free(at(a), at(b) + 1)
    )
    of = lambda a, b: F.lit(2.0) * common(a, b - a + 1) / (F.size(F.array_distinct(F.slice("grams", at(a), at(b) - at(a) + 1))) + F.col("t.n"))
    runs = F.transform(
        starts,
        lambda a: F.filter(
            F.transform(ends(a), lambda b: F.struct((-of(a, b)).alias("less"), at(a).alias("first"), (at(b) + 1).alias("last"))),
            lambda r: r["less"] <= 1e-9 - least
        )
    )
    rows = rows.select("key", "t.license", F.explode(F.array(F.array_sort(F.flatten(runs)))).alias("runs"))
    apart = lambda acc, r: F.when(
        F.exists(acc, lambda x: (r["first"] <= x["last"]) & (r["last"] >= x["first"])), acc
    ).otherwise(F.concat(acc, F.array(r)))
    taken = F.aggregate("runs", F.array().cast("array<struct<less:double,first:int,last:int>>"), apart)
    return rows.select("key", "license", F.explode(taken).alias("r")).select(
        F.col("key").alias(key), F.lit("run").alias("unit"), F.col("r.first").alias("place"), "license", (-F.col("r.less")).alias("dice")
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_matches(docs).unionByName(license_runs(docs))
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_units"), F.round(F.max("dice"), 6).alias("best_dice"))


def oracle(templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> str:
    """Lines and whole texts in DuckDB's SQL, without the bounds; runs of words are held against brute force in the tests."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in templates.items())
    normal = "string_split(trim(regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH templates(license, body) AS (VALUES {values}),
t AS (SELECT license, {grams} AS g FROM (SELECT license, {normal.format("body")} AS w FROM templates)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body FROM documents),
units AS (SELECT doc_id, body FROM lines UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
u AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {normal.format("body")} AS w FROM units) WHERE len(w) > 1),
d AS (SELECT doc_id, license, 2.0::DOUBLE * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice FROM u JOIN t
      ON len(u.g) BETWEEN len(t.g) * {least} / (2 - {least}) - 1 AND len(t.g) * (2 - {least}) / {least} + 1)
SELECT doc_id, license, count(*) AS n_units, round(max(dice), 6) AS best_dice FROM d WHERE dice >= {least} - 1e-9 GROUP BY doc_id, license
"""
