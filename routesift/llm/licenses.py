"""License scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Only DataFrame functions are used. Lines that speak of licences, each also with its neighbours in
case a notice is wrapped, and whole texts that hold such a line are compared with templates by the
cosine of sparse TF-IDF vectors; document frequencies of the templates' words are counted over
all such lines. A template counts only where its key words all stand, so that words which
licences share never name one.

A file whose best lines reach ``HEADER_COSINE`` has that licence, whatever the rest of the text
resembles. A text that is mostly a licence's own text (``FILE_COSINE`` of the whole to a body, which a
notice isn't) has it too. Such a text, and a file named like a licence file, also rules its directory. Files without their own
licence take that of the nearest ancestor directory that has one; directories are resolved
first, by joining their ancestors' paths.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.joins import sized
from .common import checkpointed, lookup_join

_CC = ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
#: Licence, its key words (a minus before one that must not stand), and the wording of a notice or body.
NOTICES = (
    ("Apache-2.0", "apache", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "apache 2 0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "apache version reproduction", "Apache License Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "permission hereby granted sublicense", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("ISC", "isc", "Released under the ISC License."),
    ("ISC", "permission use copy modify distribute fee hereby granted", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE.'),
    ("BSD-3-Clause", "bsd 3 clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License."),
    ("BSD-3-Clause", "redistribution source binary forms neither endorse", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "bsd 2 clause", "Redistribution and use are permitted under the BSD 2-Clause License."),
    ("BSD-2-Clause", "redistribution source binary forms retain reproduce", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("MPL-2.0", "mozilla 2 0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla 2 0 mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("GPL-3.0", "gnu general public 3 -lesser -affero", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "gnu general public 3 free software -lesser -affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "gnu general public license version 3 2007 -lesser -affero", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-2.0", "gnu general public 2 -lesser -affero", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general public 2 free software -lesser -affero", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general public 2 -lesser", "This library is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "gnu general public 2 free software -lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "gnu general public license version 2 1991 -lesser", "GNU General Public License Version 2, June 1991"),
    ("GPL-1.0", "gnu general public license version 1 1989 -lesser", "GNU General Public License Version 1, February 1989"),
    ("LGPL-3.0", "gnu lesser general public 3", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "gnu lesser general public 3 free software", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "gnu lesser general public license version 3 2007", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "gnu lesser general public 2 1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "gnu lesser general public 2 1 free software", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "gnu lesser general public license version 2 1 1999", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-2.0", "gnu library general public 2", "This library is licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.0", "gnu library general public 2 free software", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.0", "gnu library general public license version 2 1991", "GNU Library General Public License Version 2, June 1991"),
    ("AGPL-3.0", "gnu affero general public license version 3 2007", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("AGPL-3.0", "gnu affero general public 3", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Unlicense", "unencumbered public domain", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "cc0", "Dedicated to the public domain under CC0 1.0."),
    *((f"CC-{v}-4.0", f"CC {v} 4.0", f"Licensed under CC {v} 4.0.") for v in _CC),
)
#: Every licence is also known by its identifier line.
TEMPLATES = (*NOTICES, *((name, f"spdx {name}", f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(n[0] for n in NOTICES)))
TRIGGER = "(?i)licen[sc]|copyright|spdx|redistribution and use|permission (?:is hereby|to use)|public domain|free software"
WORDS = "[a-z0-9]+"
LICENSE_FILE = "(?i)^(licen[sc]e|copying|notice)([.-].*)?$"
HEADER_COSINE, FILE_COSINE = 0.6, 0.6
#: What a forbidden word adds to the sum of key words, which then can't be the one asked for; words of a body at least.
FORBIDDEN, BODY_WORDS = -1000, 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Part number of a whole text; those of lines count from 0.
WHOLE = -1
Templates = Sequence[tuple[str, str, str]]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0))


def words_of(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_words(templates: Templates = TEMPLATES) -> list[tuple[int, str, str, int, int]]:
    """(template, license, word, count, key) of all templates: 1 for a key word, FORBIDDEN for one that must not stand, else 0."""
    out = []
    for i, (name, keys, text) in enumerate(templates):
        words, needed = words_of(text), {w for k in keys.split() if k[0] != "-" for w in words_of(k)}
        barred = [w for k in keys.split() if k[0] == "-" for w in words_of(k)]
        out += [(i, name, w, words.count(w), FORBIDDEN if w in barred else int(w in needed)) for w in dict.fromkeys([*words, *sorted(needed), *barred])]
    return out


def bodies(templates: Templates = TEMPLATES) -> list[bool]:
    """Which templates are long enough to be a licence's own text, not a notice that points at one."""
    return [len(words_of(text)) >= BODY_WORDS for _, _, text in templates]


def parents(path: Column) -> Column:
    """All ancestor directories of a path, nearest first, the root (empty) last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def spoken_lines(lines: Column) -> Column:
    """Of the lines that speak of licences: the line, the line between its neighbours, and the line with the next two."""

    def parts(x: Column, i: Column) -> Column:
        near = lambda k: F.get(lines, i + k)
        return F.when(x.rlike(TRIGGER), F.array(x, F.concat_ws(" ", near(-1), x, near(1)), F.concat_ws(" ", x, near(1), near(2))))

    return F.filter(F.transform(lines, parts), lambda p: p.isNotNull())


def weights(spoken: DataFrame, templates: Templates) -> tuple[DataFrame, list[tuple[float, int]], float]:
    """Per word of a template its idf and (template, weight, key); per template its norm and number of key words; the idf of any other word."""
    table = template_words(templates)
    words = sorted({t[2] for t in table})
    lines = spoken.select(F.explode("_lines").alias("p")).select(F.array_intersect(tokens(F.col("p")[0]), F.array(*map(F.lit, words))).alias("held"))
    seen = lines.select(F.explode(F.concat(F.array(F.lit("")), "held")).alias("word")).groupBy("word").count()
    df = {r["word"]: r["count"] for r in seen.collect()}  # at most the templates' words and the total
    total = df.get("", 0)
    idf = {w: math.log((total + 1) / (df.get(w, 0) + 1)) + 1 for w in words}
    rows = [(w, idf[w], [(i, n * idf[w] * idf[w], key) for i, _, x, n, key in table if x == w]) for w in words]
    norms = [(math.sqrt(sum((n * idf[w]) ** 2 for j, _, w, n, _ in table if j == i)), sum(key for j, *_, key in table if j == i and key > 0)) for i in range(len(templates))]
    made = spoken.sparkSession.createDataFrame(rows, "word string, idf double, held array<struct<template:int,weight:double,key:int>>")
    return made, norms, math.log(total + 1) + 1


def matches(spoken: DataFrame, templates: Templates) -> DataFrame:
    """(_id, own, whole): the best template of a file's lines and of its whole text, as (cosine, license), null without one."""
    table, norms, unknown = weights(spoken, templates)
    parts = spoken.select("_id", F.posexplode(F.flatten("_lines")).alias("part", "text")).unionByName(spoken.select("_id", F.lit(WHOLE).alias("part"), F.col("_text").alias("text")))
    counts = parts.select("_id", "part", F.explode(tokens(F.col("text"))).alias("word")).groupBy("_id", "part", "word").count()
    known = counts.join(F.broadcast(table), "word", "left")  # at most the templates' words
    square = F.struct(F.lit(None).cast("int").alias("template"), F.pow(F.col("count") * F.coalesce("idf", F.lit(unknown)), 2).alias("x"), F.lit(0).alias("key"))
    dots = F.transform(F.coalesce("held", F.array().cast("array<struct<template:int,weight:double,key:int>>")), lambda t: F.struct(t["template"].alias("template"), (F.col("count") * t["weight"]).alias("x"), t["key"].alias("key")))
    sums = known.select("_id", "part", F.explode(F.concat(F.array(square), dots)).alias("t")).groupBy("_id", "part", "t.template").agg(F.sum("t.x").alias("x"), F.sum("t.key").alias("keys"))
    each = sums.groupBy("_id", "part").agg(F.max(F.when(F.col("template").isNull(), F.sqrt("x"))).alias("norm"), F.collect_list(F.when(F.col("template").isNotNull(), F.struct("template", "x", "keys"))).alias("found"))  # at most one per template
    facts = F.array(*[F.struct(F.lit(n).alias("norm"), F.lit(k).alias("keys"), F.lit(t[0]).alias("license"), F.lit(body).alias("body")) for (n, k), t, body in zip(norms, templates, bodies(templates), strict=True)])
    scored = each.select("_id", "part", "norm", F.explode("found").alias("f")).withColumn("t", F.get(facts, F.col("f.template"))).where((F.col("f.keys") == F.col("t.keys")) & ((F.col("part") != WHOLE) | F.col("t.body")))
    rated = scored.select("_id", "part", F.struct((-F.round(F.col("f.x") / (F.col("norm") * F.col("t.norm")), 6)).alias("down"), F.col("t.license").alias("license")).alias("r"))
    best = lambda r: F.when(r.isNotNull(), F.struct((-r["down"]).alias("cosine"), r["license"].alias("license")))
    tops = rated.groupBy("_id").agg(F.min(F.when(F.col("part") != WHOLE, F.col("r"))).alias("own"), F.min(F.when(F.col("part") == WHOLE, F.col("r"))).alias("whole"))
    return tops.select("_id", best(F.col("own")).alias("own"), best(F.col("whole")).alias("whole"))


def directories(files: DataFrame) -> DataFrame:
    """(_dir, _license, _license_dir) of the directories of ``files`` that a licence file rules, or an ancestor's."""
    tops = files.where("_ruling is not null").groupBy("_dir").agg(F.min(F.struct((-F.col("_ruling.cosine")).alias("down"), F.col("_ruling.license").alias("license"))).alias("r"))
    tops = checkpointed(tops.select(F.col("_dir").alias("_at"), F.col("r.license").alias("license")))
    own = F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array("_dir"), parents(F.col("_dir"))))
    chains = files.select("_dir").distinct().select("_dir", F.posexplode(own).alias("up", "_at"))
    found = lookup_join(chains, tops, ["_at"]).where("license is not null")
    return found.groupBy("_dir").agg(F.min_by(F.struct("license", "_at"), "up").alias("near")).select("_dir", F.col("near.license").alias("_license"), F.col("near._at").alias("_license_dir"))


def scan_licenses(files: DataFrame, header_cosine: float = HEADER_COSINE, file_cosine: float = FILE_COSINE, templates: Templates = TEMPLATES) -> DataFrame:
    """The columns of ``files`` but text, and license, origin (header, file, inherited, none), cosine, license_dir.

    ``files`` needs path and text; ``templates`` are (license, key words, wording) of any number
    of licences and wordings. A null or empty text has no licence of its own; a null path is a
    file in the root. ``cosine`` is that of the own licence, null without one. Equal cosines go to
    the name that sorts first, in a directory with several licence files as in a file. Texts are
    compared whole, however long. Rows are files of their own, repeated ones too; an empty table
    gives none. Columns of ``files`` named like a result are replaced.
    """
    files = files.drop("license", "origin", "cosine", "license_dir")
    path = F.coalesce("path", F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in files.columns if c != "text"]).alias("_row")  # no names clash
    speaks = F.col("text").rlike(TRIGGER)
    marked = files.select(F.monotonically_increasing_id().alias("_id"), row, path.alias("_path"), parents(path)[0].alias("_dir"), F.when(speaks, F.col("text")).alias("_text"))
    marked = checkpointed(marked)  # fixes the ids
    spoken = checkpointed(marked.where("_text is not null").select("_id", "_text", spoken_lines(F.split("_text", "\n")).alias("_lines")))
    best = checkpointed(matches(spoken, templates))
    marked = marked.select("_id", "_row", "_path", "_dir").join(sized(best, stored=True), "_id", "left")
    header = F.when(F.col("own.cosine") >= header_cosine, F.col("own"))
    body = F.when(F.col("whole.cosine") >= file_cosine, F.col("whole"))
    named = F.element_at(F.split("_path", "/"), -1).rlike(LICENSE_FILE)
    marked = marked.withColumn("_mine", F.coalesce(header, body)).withColumn("_ruling", F.when(body.isNotNull() | named, F.col("_mine")))
    out = lookup_join(marked, checkpointed(directories(marked)), ["_dir"])
    origin = F.when(F.col("_ruling").isNotNull(), "file").when(F.col("_mine").isNotNull(), "header").when(F.col("_license").isNotNull(), "inherited").otherwise("none")
    inherited = F.col("_mine").isNull() & F.col("_license").isNotNull()
    return out.select("_row.*", F.coalesce("_mine.license", "_license").alias("license"), origin.alias("origin"), F.col("_mine.cosine").alias("cosine"), F.when(inherited, F.col("_license_dir")).alias("license_dir"))
