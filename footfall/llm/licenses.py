"""Licence scans by sparse TF-IDF cosine, in DataFrame functions only.

Notices and headings of licences are templates. What is compared with them are units of a text: runs
of up to `RUN` neighbouring segments (cut at line ends and after sentences, so a header may be
wrapped), paragraphs (cut at lines without a letter or digit, such as a lone comment mark), and the
whole text of a licence file. Grants that licences share decide nothing between them: of the templates that
some unit reaches, those that tell more (`TELLS`) go first, such as the clause that only the longer licence
has, then the best cosine counts. Units that deny a licence are skipped. An SPDX line names its licence
itself, as a whole expression, and goes before all. A file without a licence of its own takes that of the licence file in its directory, or
else in the nearest directory above.

A term's document frequency is taken over all documents; terms that no template has get the weight
of an unseen one. Units without any cue are skipped: cues are so many of each template's heaviest
terms that the rest alone can't reach the threshold. Of the other units only those go on whose terms
together can reach it with some template, whatever else they hold (both by Cauchy-Schwarz: a cosine is
at most the norm of the template's weights at the terms that the unit has). So this loses nothing.

Templates are a parameter, a list held by the driver; all else that is broadcast is counted first. A
null or empty text has no licence of its own; a null path inherits nothing. Of several licence files
in a directory the one with the highest cosine counts, then the first path, then the first licence;
cosines are rounded to nine digits, so that the order of additions decides no tie. Very long texts
are read whole. Rows that agree in path and text give the same result; an empty table gives no rows.
The columns of docs stay, whatever their names, but for `licence`, `cosine` and `licence_from`,
which are replaced.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, plain

#: Short public licence notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}
_GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
#: Headings, headers and grants as they stand in public licences.
NOTICES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "The MIT License"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT-0", "MIT No Attribution"),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("GPL-2.0", _GPL.format("General Public License", "2")),
    ("GPL-3.0", _GPL.format("General Public License", "3")),
    ("LGPL-2.1", _GPL.format("Lesser General Public License", "2.1")),
    ("LGPL-3.0", _GPL.format("Lesser General Public License", "3")),
    ("AGPL-3.0", _GPL.format("Affero General Public License", "3")),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC0-1.0", "Creative Commons Legal Code CC0 1.0 Universal"),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
#: Where a text has several notices, one that tells more goes before others: 2 for what only one licence has, 1 for
#: what a licence has and a longer one adds to, 0 for the rest, such as grants that several licences share.
TELLS = {
    "BSD 2-Clause License": 2, "BSD 3-Clause License": 2, "MIT No Attribution": 2,
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": 2,
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": 1,
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": 1,
}
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)[^/]*$"
SEGMENT_END, BLANK, RUN = r"\n|(?<=[.!?])\s+", r"\n[^\p{L}\p{N}\n]*\n", 4
#: A unit that says so is no notice: "not licensed under", "never been released under".
DENIED = r"(?i)\b(not|never|no longer)\s+((been|being|be|currently|yet)\s+)?(licen[sc]ed|released|distributed)\b"
_ONE = r"\(*[0-9A-Za-z](?:[0-9A-Za-z.+-]*[0-9A-Za-z+])?\)*"
SPDX = rf"SPDX-License-Identifier:[ \t]*({_ONE}(?:[ \t]+(?:OR|AND|WITH|or|and|with)[ \t]+{_ONE})*)"
COSINE = 0.75
#: Characters beyond which a unit isn't skipped for one denial somewhere in it.
LONG_UNIT = 1000
#: Files with a licence, or directories with one, that may be broadcast; more are joined by a shuffle.
MOST_BROADCAST = 200_000


def all_templates(templates: Mapping[str, str] | Iterable[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """(licence, text) of the given templates, or of all there are here."""
    if templates is None:
        return [*TEMPLATES.items(), *NOTICES]
    return list(templates.items() if isinstance(templates, Mapping) else templates)


def tells(text: str) -> int:
    return TELLS.get(text, 0)


def expression(text: Column) -> Column:
    """The whole expression of the first SPDX line, with single spaces, or ''; brackets that don't pair are left out."""
    found = F.regexp_replace(F.regexp_extract(text, SPDX, 1), r"[ \t]+", " ")
    count = lambda mark: F.length(found) - F.length(F.replace(found, F.lit(mark), F.lit("")))
    return F.when(count("(") == count(")"), found).otherwise(F.translate(found, "()", ""))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def small(df: DataFrame) -> DataFrame:
    """The rows, written out; broadcast while there are few. Where they are joined by a shuffle, hot keys can be split."""
    df = durable(df)
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def frequencies(texts: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many have each term of the templates."""
    own = F.array_intersect(terms(F.coalesce("text", F.lit(""))), F.array(*map(F.lit, vocabulary)))
    met = texts.select(F.explode(F.array_union(own, F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    found = {r["term"]: r["n"] for r in met.collect()}  # a row for each template term, and "" for all
    return found.get("", 0), found


def weighted(texts: DataFrame, templates: list[tuple[str, str]], least: float) -> tuple[DataFrame, float, set[str], dict[str, list[float]]]:
    """(term, idf, at: template and weight in it) for the templates' terms, the idf of other terms, the cues, and squared weights by term."""
    vectors = [Counter(re.findall(r"[^\W_]+", t.lower())) for _, t in templates]
    vocabulary = sorted({w for v in vectors for w in v})
    n, df = frequencies(texts, vocabulary)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}
    cues: set[str] = set()
    at: dict[str, list[tuple[int, float]]] = {w: [] for w in vocabulary}
    for k, v in enumerate(vectors):
        w = {t: c * idf[t] for t, c in v.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rest = norm * norm
        for t, x in sorted(w.items(), key=lambda p: (-p[1], p[0])):
            at[t].append((k, x / norm))
            if rest > 0 and math.sqrt(rest) >= 0.999 * least * norm:
                cues.add(t)
            rest -= x * x
    table = texts.sparkSession.createDataFrame([(w, idf[w], at[w]) for w in vocabulary], "term string, idf double, at array<struct<k:int,weight:double>>")
    squares = {w: [0.0] * len(templates) for w in vocabulary}
    for w, own in at.items():
        for k, x in own:
            squares[w][k] = x * x
    return table, math.log(n + 1) + 1, cues, squares


def units(texts: DataFrame, cues: set[str]) -> DataFrame:
    """(row_no, unit, terms) of the units with a cue; texts has row_no, file (a path) and text."""
    cue = r"(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, sorted(cues))) + r")(?![\p{L}\p{N}])"
    has = lambda x: F.lower(x).rlike(cue)
    some = texts.filter(has(F.col("text")))
    split = some.select("row_no", "file", "text", F.explode(F.array(F.split("text", SEGMENT_END))).alias("segs"))
    split = split.select("row_no", "file", "text", "segs", F.explode(F.array(F.transform("segs", has))).alias("cued"))
    last = lambda i, n: F.least(F.size("segs"), i + n - 1)
    inside = lambda i, n: F.exists(F.sequence(i, last(i, n)), lambda j: F.element_at("cued", j))
    starts = F.filter(F.sequence(F.lit(1), F.size("segs")), lambda i: inside(i, RUN))
    lengths = lambda i: F.filter(F.sequence(F.lit(1), last(i, RUN) - i + 1), lambda n: inside(i, n))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(lengths(i), lambda n: F.array_join(F.slice("segs", i, n), " "))))
    parts = F.filter(F.split("text", BLANK), has)
    whole = F.when(F.coalesce(F.col("file").rlike(LICENCE_FILE), F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>"))
    each = split.select("row_no", F.explode(F.array_distinct(F.concat(runs, parts, whole))).alias("unit"))
    each = each.filter(~F.col("unit").rlike(DENIED) | (F.length("unit") > LONG_UNIT))
    return each.select("row_no", F.xxhash64("unit").alias("unit"), F.explode(F.array(terms(F.col("unit")))).alias("terms"))


def within_reach(units: DataFrame, squares: dict[str, list[float]], least: float) -> DataFrame:
    """The units whose terms have squared weights of least * least or more in some template."""
    table = F.from_json(F.lit(json.dumps(squares)), "map<string,array<double>>")  # a constant; its size is that of the templates
    own = F.array_intersect("terms", F.array(*map(F.lit, squares)))
    none = F.array_repeat(F.lit(0.0), len(next(iter(squares.values()))))
    sums = F.aggregate(own, none, lambda total, term: F.zip_with(total, F.element_at(table, term), lambda x, y: x + y))
    return units.filter(F.array_max(sums) >= 0.999 * least * least)


def own_licences(texts: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """(row_no, cosine, licence) of the best unit, where it reaches the threshold, or of an SPDX line."""
    table, unseen, cues, squares = weighted(texts, templates, least)
    each = within_reach(units(texts, cues), squares, least).select("row_no", "unit", F.explode("terms").alias("term"))
    tf = each.groupBy("row_no", "unit", "term").agg(F.count("*").alias("tf")).join(F.broadcast(table), "term", "left")
    w = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    norm = F.array(F.struct(F.lit(-1).alias("k"), w.alias("weight")))
    sums = tf.select("row_no", "unit", w.alias("w"), F.explode(F.concat(norm, F.coalesce("at", F.array().cast("array<struct<k:int,weight:double>>")))).alias("p"))
    sums = sums.groupBy("row_no", "unit", "p.k").agg(F.sum(F.col("w") * F.col("p.weight")).alias("dot"))
    is_norm = F.col("k") < 0
    dotted = sums.groupBy("row_no", "unit").agg(F.sqrt(F.max(F.when(is_norm, F.col("dot")))).alias("norm"), F.collect_list(F.when(~is_norm, F.struct("k", "dot"))).alias("dots"))
    name, more = F.array(*[F.lit(licence) for licence, _ in templates]), F.array(*[F.lit(tells(t)) for _, t in templates])
    each = F.transform("dots", lambda d: F.struct(F.get(more, d["k"]).alias("tells"), F.round(d["dot"] / F.col("norm"), 9).alias("cosine"), F.get(name, d["k"]).alias("licence")))
    best = F.array_max(F.filter(each, lambda x: x["cosine"] >= least))
    found = dotted.select("row_no", best.alias("best")).filter("best is not null").groupBy("row_no").agg(F.max("best").alias("best"))
    found = found.select("row_no", "best.cosine", "best.licence")
    tag = texts.select("row_no", F.lit(1.0).alias("cosine"), expression(F.col("text")).alias("licence")).filter("licence <> ''")
    both = found.select("row_no", F.struct(F.lit(0).alias("tag"), "cosine", "licence").alias("best")).union(tag.select("row_no", F.struct(F.lit(1), "cosine", "licence")))
    return both.groupBy("row_no").agg(F.max("best").alias("best")).select("row_no", "best.cosine", "best.licence")


def above(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs: DataFrame, path_col: str = "path", templates: Mapping[str, str] | Iterable[tuple[str, str]] | None = None, least: float = COSINE) -> DataFrame:
    """docs with licence, cosine (of the file's own licence) and licence_from (the path it comes from)."""
    added = ("licence", "cosine", "licence_from")
    kept = [c for c in docs.columns if c not in added]
    renamed = plain(docs)
    of = dict(zip(docs.columns, renamed.columns, strict=True))
    rows = renamed.withColumn("row_no", F.xxhash64(of[path_col], of["text"])).withColumn("dir", above(F.col(of[path_col])))
    texts = rows.select("row_no", F.col(of[path_col]).alias("file"), F.col(of["text"]).alias("text"))
    own = durable(own_licences(texts, all_templates(templates), least))
    own = small(own.select(F.col("row_no").alias("no_of"), "cosine", F.col("licence").alias("own")))
    files = texts.select("row_no", "file").filter(F.col("file").rlike(LICENCE_FILE)).join(own, F.col("row_no") == F.col("no_of"))
    best = F.min(F.struct((-F.col("cosine")).alias("order"), "file", "own")).alias("grant")
    granted = small(files.groupBy(above(F.col("file")).alias("holder")).agg(best))

    places = rows.select("dir").filter("dir is not null").distinct()
    steps = F.split("dir", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    reached = places.select("dir", F.explode(F.array_distinct(ups)).alias("holder")).join(granted, "holder")
    reached = small(reached.groupBy(F.col("dir").alias("dir_of")).agg(F.max_by("grant", F.length("holder")).alias("grant")))

    out = rows.join(own, F.col("row_no") == F.col("no_of"), "left").join(reached, F.col("dir") == F.col("dir_of"), "left")
    return out.select(
        *[F.col(of[c]).alias(c) for c in kept],
        F.coalesce("own", "grant.own").alias("licence"),
        "cosine",
        F.when(F.col("own").isNotNull(), F.col(of[path_col])).otherwise(F.col("grant.file")).alias("licence_from"),
    )
