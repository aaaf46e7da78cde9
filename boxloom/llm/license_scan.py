"""License scans with DataFrame functions only.

Templates are licence texts and notices. A file's lines, its blocks of lines between lines without words, the
sentences of either and the file as a whole are compared with them by the cosine of sparse TF-IDF vectors;
the best template at or above THRESHOLD is the file's own licence. A file without one takes that of the
nearest directory above it which holds a licence file.

Inverse document frequencies come from the templates, which are a fixed collection; a word in none of them
weighs most. So a line's vector needs no statistics of other lines. A line that lacks the rarest words
of a template can't reach the threshold with it, whatever else they share: files and lines without any such
word are left before any join, and so are lines that share too little with all templates together.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.shared import ascii_lower, fresh
from boxloom.sources.durable import durable

THRESHOLD = 0.7
#: (licence, template). Several templates may stand for one licence.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License. Unless required by applicable law or agreed to in writing, software distributed under the License "
        "is distributed on an as is basis, without warranties or conditions of any kind, either express or implied.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Proprietary", "All rights reserved."),
)
#: Headers and short notices (licence, notice, words a unit must have): alike but for a name or a version, so the
#: cosine alone would take one for another. They leave the weights of TEMPLATES as they are.
NOTICES = (
    ("MIT", "This file is licensed under the MIT License.", ("mit",)),
    ("Apache-2.0", "This file is licensed under the Apache License, Version 2.0.", ("apache", "2")),
    ("GPL-3.0", "This work is licensed under GPL version 3.", ("gpl", "3")),
    ("GPL-3.0", "This file is licensed under the GPLv3.", ("gplv3",)),
    ("BSD-3-Clause", "This file is licensed under the BSD 3-Clause License.", ("bsd", "3", "clause")),
    ("MPL-2.0", "This file is licensed under the Mozilla Public License 2.0.", ("mozilla", "2")),
    (
        "GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation; either version 2 of the License, or any later version.",
        ("gnu", "general", "2"),
    ),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", ("gnu", "general", "2")),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        ("lesser", "2", "1"),
    ),
    (
        "LGPL-3.0",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or any later version.",
        ("lesser", "3"),
    ),
    (
        "AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or any later version.",
        ("affero", "3"),
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
        ("permission", "fee", "granted"),
    ),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", ("eclipse", "2")),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", ("unencumbered", "domain")),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.", ("boost", "license", "1")),
    (
        "Zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software.",
        ("authors", "liable", "damages"),
    ),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.", ("artistic", "2")),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("attribution", "sharealike")),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ("noncommercial", "sharealike")),
)
#: Licences that a tag names, and the words of the name that must be there.
TAGGED = (
    "MIT Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0 BSD-2-Clause BSD-3-Clause MPL-2.0 ISC EPL-2.0 Unlicense BSL-1.0 Zlib Artistic-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0"
).split()
TAGS = tuple((name, f"SPDX-License-Identifier: {name}", ("spdx", *[w for w in name.lower().replace(".", "-").split("-") if w != "by"])) for name in TAGGED)
NOTICES += TAGS
#: Words that a unit must not have, whatever else it shares with a licence's templates.
NEVER = {
    "GPL-2.0": ("lesser", "library", "affero", "lgpl", "agpl", "3", "gplv3"),
    "GPL-3.0": ("lesser", "library", "affero", "lgpl", "agpl", "2", "gplv2"),
    "LGPL-2.1": ("affero", "agpl", "3"),
    "LGPL-3.0": ("affero", "agpl", "2"),
    "CC-BY-4.0": ("noncommercial", "sharealike", "noderivatives", "noderivs", "nc", "sa", "nd"),
    "CC-BY-SA-4.0": ("noncommercial", "nc", "noderivatives", "nd"),
    "CC-BY-NC-4.0": ("sharealike", "sa", "noderivatives", "noderivs", "nd"),
    "CC-BY-NC-SA-4.0": ("noderivatives", "nd"),
}
#: Function words, which count for nothing.
STOP_WORDS = tuple(
    "a an and any are as at be been by can do either for from has have in including is it its may not of on or so such that the their this to under unless was were whom with without you".split()
)
GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: What parts blocks: lines without words; and what parts sentences.
WORDLESS = r"[^0-9A-Za-z\x{80}-\x{10FFFF}]*\n"
SENTENCE = r"(?<=[.!?])\s+"


def words_of(text: Column) -> Column:
    """Lower-cased words (A-Z only) of letters and digits; any non-ASCII character is part of a word."""
    return F.array_remove(F.split(ascii_lower(text), GAP), "")


def _words(text: str) -> list[str]:
    parts = re.split(r"[^0-9a-z\x80-\U0010FFFF]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return [w for w in parts if w and w not in STOP_WORDS]


class Model:
    """Weights of template words: ``idf`` by word, ``rare`` for others, ``unit`` (template, word) -> weight.

    ``must`` has the words without which a template, by its number, does not count, ``never`` those with which it does
    not. ``notices`` come after ``templates`` and have no part in the frequencies.
    """

    def __init__(self, templates: tuple = TEMPLATES, notices: tuple = (), never: dict = NEVER):
        bags = [Counter(_words(t)) for _, t in templates]
        seen = Counter(w for bag in bags for w in bag)
        self.names = [name for name, *_ in (*templates, *notices)]
        self.must = {len(templates) + k: set(words) for k, (_, _, words) in enumerate(notices)}
        self.never = {k: set(never[name]) for k, name in enumerate(self.names) if name in never}
        self.idf = {w: math.log((1 + len(bags)) / (1 + n)) + 1 for w, n in sorted(seen.items())}
        self.rare = math.log(1 + len(bags)) + 1
        bags += [Counter(_words(t)) for _, t, _ in notices]
        self.idf |= {w: self.rare for bag in bags for w in bag if w not in self.idf}
        self.unit = []
        for k, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items()))
            self.unit += [(k, w, n * self.idf[w] / norm) for w, n in sorted(bag.items())]

    def anchors(self, threshold: float) -> list[str]:
        """Words of which every text with a cosine of ``threshold`` to some template has at least one.

        Of each template its rarest words, until the others' part of its unit vector is shorter than that. Of a
        template with words that must be there, one of those.
        """
        out = set()
        for t in range(len(self.names)):
            if t in self.must:
                out.add(max(self.must[t], key=lambda w: (self.idf[w], len(w), w)))
                continue
            rest = 1.0
            for _, w, x in sorted((u for u in self.unit if u[0] == t), key=lambda u: (-self.idf[u[1]], -len(u[1]), u[1])):
                if rest < threshold**2 * (1 - 1e-9):
                    break
                out.add(w)
                rest -= x * x
        return sorted(out)


def units_of(text: Column) -> Column:
    """What of ``text`` is compared, as an array of (at, line).

    ``at`` is 0 for the whole text and the number of a line, from 1. A block of several lines that opens the text is
    at 1, as are its first sentence and all sentences of the first line; what comes later is at 2.
    """
    unit = lambda at, line: F.struct(at.cast("int").alias("at"), line.alias("line"))
    later = lambda first: F.when(first, 1).otherwise(2)
    lines = F.transform(F.split(text, "\n"), lambda x, i: unit(i + 1, x))
    blocks = F.split(F.regexp_replace(text, "^" + WORDLESS, ""), "\n" + WORDLESS)
    blocks = F.filter(F.transform(blocks, lambda x, i: unit(later(i == 0), x)), lambda u: F.contains(u.line, F.lit("\n")))
    several = lambda units: F.filter(units, lambda u: u.line.rlike(SENTENCE))
    of_lines = F.transform(several(lines), lambda u: F.transform(F.split(u.line, SENTENCE), lambda s: unit(later(u.at == 1), s)))
    of_blocks = F.transform(several(blocks), lambda u: F.transform(F.split(u.line, SENTENCE), lambda s, i: unit(later((u.at == 1) & (i == 0)), s)))
    return F.concat(F.array(unit(F.lit(0), text)), lines, blocks, F.flatten(of_lines), F.flatten(of_blocks))


def own_licences(files: DataFrame, model: Model, threshold: float) -> DataFrame:
    """(file_key, licence, score, first_line) of every file with a template at or above ``threshold``.

    ``files`` is (file_key, text). Units are what ``units_of`` gives. Of equal scores the earlier template wins.
    ``first_line``: the best unit opens the text or is the whole of it.
    """
    spark = files.sparkSession
    idf = F.create_map(*[x for w, v in model.idf.items() for x in (F.lit(w), F.lit(v))])
    text = F.coalesce("text", F.lit(""))
    anchors = model.anchors(threshold)
    some = lambda words: F.exists(words, lambda x: x.isin(anchors))
    units = files.where(some(words_of(text))).select("file_key", F.posexplode(units_of(text)).alias("unit", "u")).select("file_key", "unit", "u.at", "u.line")
    # What a unit shares with all templates must be threshold ** 2 of its squared length at least, and every
    # other word adds rare ** 2 to that length or more.
    mass = lambda known: F.aggregate(
        F.array_distinct(known), F.lit(0.0), lambda acc, x: acc + F.pow(F.size(F.filter(known, lambda y: y == x)) * idf[x], F.lit(2.0))
    )
    split = lambda w: F.struct(F.filter(w, lambda x: ~x.isin(*STOP_WORDS)).alias("w"), F.filter(w, lambda x: x.isin(list(model.idf))).alias("known"))
    weigh = lambda b: F.struct(b.w.alias("w"), mass(b.known).alias("mass"), ((F.size(b.w) - F.size(b.known)) * model.rare**2).alias("others"))
    shares = lambda b: b.mass * (1 + 1e-9) >= threshold**2 * (b.mass + b.others)
    # One unit's words are bound by lambdas, step by step: as columns, a filter would work them out anew wherever it names them.
    bag = F.transform(F.filter(F.array(words_of(F.col("line"))), some), split)
    near = units.select("file_key", "unit", "at", F.explode(F.filter(F.transform(bag, weigh), shares)).alias("b")).select("file_key", "unit", "at", "b.w")
    counts = near.select("file_key", "unit", "at", F.explode("w").alias("word")).groupBy("file_key", "unit", "at", "word").agg(F.count("*").alias("tf"))
    shared = [(k, w, x, int(w in model.must.get(k, ())), 0) for k, w, x in model.unit]
    barred = [(k, w, 0.0, 0, 1) for k, words in model.never.items() for w in sorted(words)]
    weights = spark.createDataFrame(shared + barred, "template int, t_word string, weight double, must int, never int")
    needed = F.array(*[F.lit(len(model.must.get(k, ()))) for k in range(len(model.names))])
    idfs = spark.createDataFrame(sorted(model.idf.items()), "i_word string, idf double")
    weighed = durable(
        counts.join(F.broadcast(idfs), F.col("word") == F.col("i_word"), "left").select(
            "file_key", "unit", "at", "word", (F.col("tf") * F.coalesce("idf", F.lit(model.rare))).alias("x")
        )
    )
    norms = weighed.groupBy("file_key", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    names = F.array(*[F.lit(n) for n in model.names])
    scored = (
        weighed.join(F.broadcast(weights), F.col("word") == F.col("t_word"))
        .groupBy("file_key", "unit", "at", "template")
        .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"), F.sum("must").alias("must"), F.sum("never").alias("never"))
        .where((F.col("must") == F.get(needed, F.col("template"))) & (F.col("never") == 0))
        .join(norms, ["file_key", "unit"])
        .select("file_key", "at", "template", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
        .where(F.col("score") >= threshold)
    )
    return (
        scored.groupBy("file_key")
        .agg(F.max(F.struct("score", (-F.col("template")).alias("t"), (-F.col("at")).alias("u"))).alias("best"))
        .select("file_key", F.element_at(names, 1 - F.col("best.t")).alias("licence"), F.col("best.score").alias("score"), (F.col("best.u") >= -1).alias("first_line"))
    )


#: Names that ``scan`` uses on its way.
HIDDEN = ("licence", "score", "how", "licence_dir", "file_key", "first_line", "own_key", "folder", "l_dir", "dir_licence", "u_folder", "up", "above")


def parents_of(path: Column) -> Column:
    """The directories above ``path``, outermost first; '' is the root."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(files: DataFrame, licence_file: Column, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``files`` (path, text and others): its columns, licence, score, how and licence_dir.

    ``how`` is own, inherited or none. ``licence_file`` tells, from the columns of ``files`` and first_line, whether
    a file with an own licence speaks for its directory; of several in one directory the best score, then
    the least path, counts. A null text has no licence of its own; a null path inherits nothing. Rows that
    repeat a path and text come back as often.
    """
    model = model or Model(notices=NOTICES)
    clashing = [c for c in files.columns if c in HIDDEN]
    hidden = dict(zip(clashing, fresh(files, *clashing)))
    keyed = files.withColumnsRenamed(hidden).withColumn("file_key", F.sha2(F.concat_ws("\n", F.coalesce("path", F.lit("\0")), F.coalesce("text", F.lit("\0"))), 256))
    own = durable(own_licences(keyed.select("file_key", "text"), model, threshold))
    seen = keyed.join(own.withColumnRenamed("file_key", "own_key"), F.col("file_key") == F.col("own_key"), "left").drop("own_key", "file_key")
    folder = F.regexp_replace(F.regexp_extract("path", "(?s)^(.*/)?", 0), "/$", "")
    seen = seen.withColumn("folder", folder)
    by_dir = (
        seen.where(F.col("licence").isNotNull() & F.col("path").isNotNull() & licence_file)
        .groupBy("folder")
        .agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "licence")).alias("best"))
        .select(F.col("folder").alias("l_dir"), F.col("best.licence").alias("dir_licence"))
    )
    by_dir = durable(by_dir)
    # Directories are far fewer than files and are resolved first, each by its ancestors.
    folders = seen.where("path is not null").select("folder").distinct()
    nearest = (
        folders.select("folder", F.explode(F.array_append(parents_of(F.col("folder")), F.col("folder"))).alias("above"))
        .distinct()
        .join(by_dir, F.col("above") == F.col("l_dir"))
        .groupBy("folder")
        .agg(F.max_by(F.struct(F.col("l_dir"), "dir_licence"), F.length("l_dir")).alias("up"))
        .select(F.col("folder").alias("u_folder"), "up")
    )
    found = seen.join(nearest, F.col("folder") == F.col("u_folder"), "left")
    has = F.col("licence").isNotNull()
    return found.select(
        *[F.col(hidden.get(c, c)).alias(c) for c in files.columns if c not in hidden],
        *[F.col(v).alias(k) for k, v in hidden.items() if k not in ("licence", "score", "how", "licence_dir")],
        F.coalesce("licence", "up.dir_licence").alias("licence"),
        "score",
        F.when(has, "own").when(F.col("up").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~has, F.col("up.l_dir")).alias("licence_dir"),
    )


def document_files(docs: DataFrame) -> DataFrame:
    """``docs`` as files source/<thousands>/<hundreds>/<tens>/<doc_id>, with round ids in the directories further up.

    The file of a round id is the ``index`` of its directory: a notice in it speaks for the directory, as does one that
    opens any file. A null source is called unknown; a null doc_id has no path.
    """
    level = lambda n: F.when(F.col("doc_id") % n != 0, F.floor(F.col("doc_id") / n).cast("string"))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), level(1000), level(100), level(10), F.col("doc_id").cast("string"))
    return docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), path).alias("path"), F.coalesce(F.col("doc_id") % 10 == 0, F.lit(False)).alias("index"))


def _oracle() -> str:
    m = Model(notices=NOTICES)
    quote = lambda w: "'" + w.replace("'", "''") + "'"
    idf = ", ".join(f"({quote(w)}, {v!r}::double)" for w, v in sorted(m.idf.items()))
    unit = ", ".join(f"({t}, {quote(w)}, {v!r}::double, {int(w in m.must.get(t, ()))})" for t, w, v in m.unit)
    needed = ", ".join(f"({k}, {len(m.must.get(k, ()))})" for k in range(len(m.names)))
    barred = ", ".join(f"({k}, {quote(w)})" for k, words in m.never.items() for w in sorted(words))
    names = ", ".join(f"({k}, {quote(n)})" for k, n in enumerate(m.names))
    return f"""
with i(word, idf) as (values {idf}), tw(t, word, weight, must) as (values {unit}), nd(t, needed) as (values {needed}), nv(t, word) as (values {barred}), names(t, licence) as (values {names}),
g as (select doc_id, coalesce(text, '') as text, concat_ws('/', coalesce(source, 'unknown'), case when doc_id % 1000 <> 0 then cast(doc_id // 1000 as varchar) end, case when doc_id % 100 <> 0 then cast(doc_id // 100 as varchar) end, case when doc_id % 10 <> 0 then cast(doc_id // 10 as varchar) end) as folder from documents),
f as (select *, folder || '/' || cast(doc_id as varchar) as path from g),
u as (select doc_id, 0 as unit, text as line from f union all
      select doc_id, generate_subscripts(string_split(text, chr(10)), 1), unnest(string_split(text, chr(10))) from f),
w as (select doc_id, unit, unnest(list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), lambda x: x <> '' and x not in ({", ".join(map(quote, STOP_WORDS))}))) as word from u),
c as (select doc_id, unit, w.word, count(*) * coalesce(any_value(idf), {m.rare!r}::double) as x from w left join i on w.word = i.word group by doc_id, unit, w.word),
n as (select doc_id, unit, sqrt(sum(x * x)) as norm from c group by doc_id, unit),
b as (select distinct doc_id, unit, t from c join nv on c.word = nv.word),
m as (select c.doc_id, c.unit, t, round(sum(x * weight) / any_value(norm), 6) as score, sum(must) as must from c join tw on c.word = tw.word join n on n.doc_id = c.doc_id and n.unit = c.unit group by c.doc_id, c.unit, t having score >= {THRESHOLD}),
s as (select doc_id, unit, t, score from m join nd using (t) where must = needed and (doc_id, unit, t) not in (select (doc_id, unit, t) from b)),
own as (select doc_id, licence, score, unit <= 1 as first_line from (select *, row_number() over (partition by doc_id order by score desc, t, unit) as k from s) join names using (t) where k = 1),
d as (select folder, licence as dir_licence from (select folder, licence, row_number() over (partition by folder order by score desc, path, licence) as k from f join own using (doc_id) where first_line or doc_id % 10 = 0) where k = 1),
up as (select folder, unnest(list_transform(range(0, len(string_split(folder, '/')) + 1), lambda i: array_to_string(string_split(folder, '/')[1:i], '/'))) as above from (select distinct folder from f)),
near as (select up.folder, arg_max({{'d': d.folder, 'l': d.dir_licence}}, length(d.folder)) as n from up join d on above = d.folder group by up.folder),
a as (select f.*, own.licence as own_licence, own.score, n.l as dir_licence, n.d as l_dir from f left join own using (doc_id) left join near using (folder))
select doc_id, path, coalesce(own_licence, dir_licence) as licence, score,
  case when own_licence is not null then 'own' when dir_licence is not null then 'inherited' else 'none' end as how,
  case when own_licence is null then l_dir end as licence_dir
from a
"""


ORACLE = _oracle()
