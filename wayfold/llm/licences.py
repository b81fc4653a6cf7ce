"""Licence scans (operator 1, DataFrame functions only).

Statements that name a licence, and the whole text of licence files, are compared to templates by the cosine
of sparse TF-IDF vectors. A licence file speaks for its directory; a file without a statement of its own takes
the licence of its nearest ancestor directory that has one, found by joins on the paths.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_SHARE, small, stage, table, with_facts

#: Cosine from which a unit may count, and the share of a template's squared weight that it must hold more than;
#: templates of up to ``SHORT`` terms, and identifiers, must be held whole.
NEAR, HELD, SHORT = 0.6, 0.5, 6
TERM_BREAK = "[^a-z0-9]+"
#: What a statement must contain, in lower case, and how licence files are named.
ANCHORS = ("licence", "license", "copyright", "copyleft", "spdx", "creative commons", "public domain", "rights reserved", "permission is hereby", "redistribution", "released under", "free software", "general public", "endorse or promote", "advertising materials", "permission is granted")
#: What turns a statement into its opposite: such a sentence or line states nothing.
NEGATED = r"(?i)(\bnot|\bnever|\bno longer|n't)\s+(\w+\s+){0,2}(licen[cs]ed|released|available|distributed)\s+(\w+\s+){0,2}under\b"
FILE_NAME = r"(?i)^(un)?(licen[cs]e|copying|copyright|notice)([-._].*)?$"
#: The marks that comment lines begin with.
COMMENT = r"(^|[\r\n])[ \t]*(?:#+|/+\*+|\*+/?|/{2,}|-{2,}|;+|%+)?[ \t]*"
BREAK = "\x01"
#: The parts of the BSD texts, and identifiers by licence.
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_ADVERTISING = " 3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES."
GNU = {"GPL-2.0": ("General", "2", "June 1991"), "GPL-3.0": ("General", "3", "29 June 2007"), "LGPL-2.1": ("Lesser General", "2.1", "February 1999"), "LGPL-3.0": ("Lesser General", "3", "29 June 2007"), "AGPL-3.0": ("Affero General", "3", "19 November 2007")}
SPDX = ("MIT", "MIT-0", "Apache-2.0", "MPL-2.0", "EPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "ISC", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "BSL-1.0", "Zlib", "LGPL-2.0", *GNU)
#: Licences and how they are usually stated. Notices of the GNU licences and identifiers follow by rule.
STATED = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT license."),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "This project is licensed under the MIT License, see the LICENSE file for details."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions."),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION."),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("EPL-2.0", "Eclipse Public License v 2.0"),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause Simplified License."),
    ("BSD-2-Clause", BSD),
    ("BSD-2-Clause", BSD + BSD_END),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause New or Revised License."),
    ("BSD-3-Clause", BSD + BSD_NAMES),
    ("BSD-3-Clause", BSD + BSD_NAMES + BSD_END),
    ("BSD-4-Clause", "BSD 4-Clause License"),
    ("BSD-4-Clause", "Licensed under the BSD 4-Clause Original License."),
    ("BSD-4-Clause", BSD + BSD_ADVERTISING + BSD_NAMES.replace("3.", "4.")),
    ("BSD-4-Clause", BSD + BSD_ADVERTISING + BSD_NAMES.replace("3.", "4.") + BSD_END),
    ("BSD", "Licensed under the BSD license."),
    ("BSD", "governed by a BSD-style license"),
    ("Zlib", "zlib License"),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("ISC", "ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSL-1.0", "Boost Software License Version 1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under Creative Commons CC0 1.0 Universal."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "Copyright, all rights reserved, no copying permitted."),
)


def gnu_notices(name: str) -> list[tuple[str, str]]:
    """How works name a GNU licence: in a sentence, in the header that it asks for, in its own title."""
    kind, version, date = GNU[name]
    what = "library" if version == "2.1" else "program"
    return [
        (name, f"This work is licensed under the GNU {kind} Public License, version {version}."),
        (name, f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation; either version {version} of the License, or (at your option) any later version."),
        (name, f"GNU {kind.upper()} PUBLIC LICENSE Version {version}, {date}"),
    ]


def identifiers(name: str) -> list[tuple[str, str]]:
    ids = [name, f"{name}-only", f"{name}-or-later", f"{name}+"] if "GPL" in name else [name]
    return [(name, f"SPDX-License-Identifier: {i}") for i in ids]


#: How the licences that are often offered together are called.
CALLED = {"Apache-2.0": "Apache License, Version 2.0", "BSD-2-Clause": "BSD 2-Clause license", "BSD-3-Clause": "BSD 3-Clause license", "GPL-2.0": "GNU General Public License version 2", "GPL-3.0": "GNU General Public License version 3", "LGPL-2.1": "GNU Lesser General Public License version 2.1", "MIT": "MIT license", "MPL-2.0": "Mozilla Public License 2.0"}
#: The share of a statement of two licences that a unit must hold more than: one of them alone is less.
BOTH_HELD = 0.85


#: Two pairs whose statements have the same words in another order, which bags of words cannot tell apart; of these one licence is named.
ALIKE = {("BSD-2-Clause", "GPL-3.0"), ("BSD-3-Clause", "GPL-2.0")}


def together(a: str, b: str) -> list[tuple[str, str]]:
    """Statements of two licences, as SPDX expressions name them: one of them as the reader likes, or both at once."""
    named = [(x, y) for x in ([a, f"{a}-only", f"{a}-or-later"] if a in GNU else [a]) for y in ([b, f"{b}-only", f"{b}-or-later"] if b in GNU else [b])]
    return [
        *[(f"{a} {word} {b}", f"SPDX-License-Identifier: {x} {word} {y}") for word in ("OR", "AND") for x, y in named],
        (f"{a} OR {b}", f"Licensed under either of {CALLED[a]} or {CALLED[b]} at your option."),
        (f"{a} OR {b}", f"Dual licensed under the {CALLED[a]} or the {CALLED[b]}."),
    ]


TEMPLATES = (*STATED, *(t for name in GNU for t in gnu_notices(name)), *(t for name in SPDX for t in identifiers(name)), *(t for pair in combinations(CALLED, 2) if pair not in ALIKE for t in together(*pair)))


def template_words(text: str) -> set[str]:
    return {t for t in re.split(TERM_BREAK, text.lower()) if t}


def least_held(name: str, text: str) -> float:
    """The share of a template that a unit must hold more than."""
    if " " in name and not text.startswith("SPDX"):
        return BOTH_HELD
    return 1 - 1e-6 if text.startswith("SPDX") or len(template_words(text)) <= SHORT else HELD


VOCABULARY = tuple(sorted(set().union(*(template_words(text) for _, text in TEMPLATES))))
#: Terms that no template has weigh as little as one that every document holds: names and years must not hide a statement.
UNSEEN = 1.0
#: A document's units: its statements over line ends, line by line, all of them together, and a licence file's whole text.
SENTENCE, LINE, NOTICE, WHOLE = range(4)


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM_BREAK), lambda t: t != "")


def names_licence(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(F.lower(text), F.lit(a)) for a in ANCHORS])


def states_licence(text: Column) -> Column:
    return names_licence(text) & ~text.rlike(NEGATED)


def uncommented(text: Column) -> Column:
    return F.regexp_replace(text, COMMENT, "$1")


def statements(text: Column) -> Column:
    """The sentences that name a licence, in order. Lines that follow each other are one text, whether or not they
    are comments; an empty line or comment ends a sentence."""
    joined = F.translate(F.regexp_replace(F.regexp_replace(uncommented(text), "\r\n?", "\n"), "\n(?:[ \t]*\n)+", BREAK), "\n", " ")
    return F.filter(F.split(F.regexp_replace(joined, "([.!?])[ \t]+", "$1" + BREAK), BREAK), states_licence)


def lines(text: Column) -> Column:
    """The lines, and sentences within lines, that name a licence, in order."""
    return F.filter(F.split(F.regexp_replace(uncommented(text), "([.!?])[ \t\r\n]+", "$1\n"), "[\r\n]+"), states_licence)


def template_terms(spark: SparkSession) -> DataFrame:
    """(template, licence, least, term, tf): a few rows for each of ``TEMPLATES``."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(name).alias("licence"), F.lit(least_held(name, text)).alias("least"), F.lit(text).alias("text")) for i, (name, text) in enumerate(TEMPLATES)])
    each = spark.range(1).select(F.inline(rows)).select("template", "licence", "least", F.explode(terms(F.col("text"))).alias("term"))
    return each.groupBy("template", "licence", "least", "term").agg(F.count("*").alias("tf"))


def matched(units: DataFrame, idf: DataFrame, near: float = NEAR) -> DataFrame:
    """(row, kind, pos, licence, score) of each unit (row, kind, pos, text) with its best template, if one has a cosine of
    ``near`` or more and is held to the share it asks for.

    ``idf`` has (term, idf) for the templates' terms, one row each; other terms weigh ``UNSEEN``. Equal scores go
    to the earlier template. Scores are rounded to six places first, so that the order of sums decides nothing.
    """
    key = ["row", "kind", "pos"]
    of_templates = template_terms(units.sparkSession).join(F.broadcast(idf), "term").withColumn("t", F.col("tf") * F.col("idf"))
    lengths = of_templates.groupBy("template").agg(F.sqrt(F.sum(F.col("t") * F.col("t"))).alias("t_length"))
    # As many rows as the templates have words.
    of_templates = stage(of_templates.join(F.broadcast(lengths), "template").select("template", "licence", "least", "term", (F.col("t") / F.col("t_length")).alias("t")), "licence-templates")
    found = units.select(*key, F.explode(terms(F.col("text"))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    weighed = found.join(F.broadcast(idf), "term", "left").select(*key, "term", (F.col("tf") * F.coalesce("idf", F.lit(UNSEEN))).alias("w"))
    lengths = weighed.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.join(F.broadcast(of_templates), "term").groupBy(*key, "template", "licence", "least").agg(F.sum(F.col("w") * F.col("t")).alias("dot"), F.round(F.sum(F.col("t") * F.col("t")), 6).alias("held"))
    scored = dots.where(F.col("held") > F.col("least")).join(lengths, key).withColumn("score", F.round(F.col("dot") / F.col("length"), 6)).where(F.col("score") >= near)
    best = scored.groupBy(*key).agg(F.max(F.struct("score", (-F.col("template")).alias("order"), "licence")).alias("b"))
    return best.select(*key, "b.licence", "b.score")


def parent(path: Column) -> Column:
    """The directory of a path; '' for what lies at the top."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, down to ''."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.concat_ws("/", F.slice(parts, F.lit(1), n)).alias("above")))


def scan(files: DataFrame, path: Column, text: Column, keep: dict[str, Column], near: float = NEAR) -> DataFrame:
    """The columns of ``keep`` for each row of ``files`` with its path, licence, via, score and declared_in.

    A licence is named by its SPDX identifier; two that are offered or hold together by an expression with OR or AND, their names in
    order of the alphabet. A sentence that says that something is not licensed so states nothing.
    ``via`` is ``statement`` where the text itself states the licence, or ``inherited``; else it, the
    licence and the score are null. A licence file is one that is so named, or of whose words at least half
    stand in statements. Of a text's units the best counts, then sentences before lines before all together, then
    the first; of a directory's licence files the best, then the one whose licence comes first by name. Document
    frequencies are those of all rows. A null or empty text states nothing; a null path lies at the top under no
    name; repeated rows are scanned alike; an empty table gives an empty result. The texts are read once; later
    steps read the staged digest, which holds the statements alone.
    """
    spark = files.sparkSession
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(path, F.lit("")), "/+", "/"), "^/|/$", "")
    body = F.coalesce(text.cast("string"), F.lit(""))
    # What the caller keeps travels in one struct, so that its names cannot clash with these.
    read = files.select(F.struct(*[c.alias(n) for n, c in keep.items()]).alias("kept"), clean.alias("path"), body.alias("text"))
    named = F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME)
    none = F.array().cast("array<string>")
    states, by_line = (F.when(names_licence(F.col("text")), f(F.col("text"))).otherwise(none) for f in (statements, lines))
    tokens = terms(F.col("text"))
    seen = F.array_intersect(tokens, F.array(*map(F.lit, VOCABULARY)))
    digest = read.select(F.monotonically_increasing_id().alias("row"), "kept", "path", parent(F.col("path")).alias("dir"), named.alias("named"), F.size(tokens).alias("n_words"), seen.alias("seen"), states.alias("states"), by_line.alias("by_line"), F.when(named, F.col("text")).alias("whole"))
    digest = stage(digest, "licence-digest")

    counts = digest.select(F.explode("seen").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = digest.count()
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, VOCABULARY))).alias("term"))
    idf = stage(every.join(counts, "term", "left").select("term", (F.log((1.0 + F.lit(n)) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0).alias("idf")), "licence-idf")

    each = lambda kind, column: digest.select("row", F.lit(kind).alias("kind"), F.posexplode(column).alias("pos", "text"))
    notices = digest.where(F.size("states") > 1).select("row", F.lit(NOTICE).alias("kind"), F.lit(0).alias("pos"), F.array_join("states", " ").alias("text"))
    wholes = digest.where("whole is not null").select("row", F.lit(WHOLE).alias("kind"), F.lit(0).alias("pos"), F.col("whole").alias("text"))
    units = each(SENTENCE, "states").unionByName(each(LINE, "by_line")).unionByName(notices).unionByName(wholes)
    hits = matched(units, idf, near).join(units.select("row", "kind", "pos", F.size(terms(F.col("text"))).alias("words")), ["row", "kind", "pos"])
    words = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("words")).otherwise(0))
    own = hits.groupBy("row").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"), (-F.col("pos")).alias("p"), "licence")).alias("b"), F.greatest(words(SENTENCE), words(LINE)).alias("covered"))
    own = stage(own.select("row", "b.licence", "b.score", "covered"), "licence-own")

    stated = digest.select("row", "dir", "named", "n_words").join(small(own), "row")
    speaks = stated.where(F.col("named") | (2 * F.col("covered") >= F.col("n_words")))
    of_dirs = stage(speaks.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("low"), "licence")).alias("b")).select(F.col("dir").alias("above"), "b.licence", (-F.col("b.low")).alias("score")), "licence-dirs")
    # The top is above every directory, and others are above many: these meet their lines where the lines are.
    up = stage(digest.select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("a")).select("dir", "a.*"), "licence-lines")
    below = stage(up.groupBy("above").agg(F.count("*").alias("dirs")).join(of_dirs, "above"), "licence-above")
    nearest = with_facts(up, below, "above", F.col("dirs") > HOT_SHARE * up.count()).groupBy("dir").agg(F.max(F.struct("depth", "above", "licence", "score")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"), F.col("b.score").alias("dir_score"), F.col("b.above").alias("declared_in"))
    nearest = stage(nearest, "licence-nearest")

    out = digest.select("row", "kept", "path", "dir").join(small(own.drop("covered")), "row", "left").join(small(nearest), "dir", "left")
    via = F.when(F.col("licence").isNotNull(), "statement").when(F.col("dir_licence").isNotNull(), "inherited")
    return out.select("kept.*", "path", F.coalesce("licence", "dir_licence").alias("licence"), via.alias("via"), F.coalesce("score", "dir_score").alias("score"), F.when(F.col("licence").isNull(), F.col("declared_in")).alias("declared_in"))


def document_path(source: Column, lang: Column, doc_id: Column) -> Column:
    """Where a document stands that has no path of its own: source / language / id."""
    return F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("_")) for c in (source, lang, doc_id)])


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, by its own statement or by its directory."""
    docs = table(spark, sf_dir, "documents")
    return scan(docs, document_path(F.col("source"), F.col("lang"), F.col("doc_id")), F.col("text"), {"doc_id": F.col("doc_id")})


def _sql_list(strings: tuple[str, ...]) -> str:
    return ", ".join("'" + s.replace("'", "''") + "'" for s in strings)


_ANCHORED = " or ".join(f"contains(lower(body), '{a}')" for a in ANCHORS)
_TOKENS = f"list_filter(regexp_split_to_array(lower(body), '{TERM_BREAK}'), lambda t: t <> '')"
OP1_SQL = f"""
with templates(template, licence, least, body) as (values {", ".join(f"({i}, {_sql_list((name,))}, {least_held(name, text)!r}::double, {_sql_list((text,))})" for i, (name, text) in enumerate(TEMPLATES))}),
docs as (select doc_id, coalesce(text, '') as body, coalesce(source, '_') || '/' || coalesce(lang, '_') as dir, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || coalesce(doc_id::varchar, '_') as path from documents),
words as (select *, {_TOKENS} as toks from docs),
t_terms as (select template, licence, least, term, count(*) as tf from (select template, licence, least, unnest({_TOKENS}) as term from templates) group by all),
vocab as (select distinct term from t_terms),
df as (select term, count(*) as df from (select unnest(list_distinct(toks)) as term from words) where term in (select term from vocab) group by term),
n as (select count(*) as n from docs),
idf as (select term, ln((1.0::double + n) / (1.0::double + coalesce(df, 0))) + 1.0::double as idf from vocab left join df using (term), n),
tw as (select template, licence, least, term, tf * idf as t from t_terms join idf using (term)),
tn as (select template, sqrt(sum(t * t)) as t_length from tw group by template),
tu as (select template, licence, least, term, t / t_length as t from tw join tn using (template)),
bare as (select doc_id, regexp_replace(body, '{COMMENT}', '\\1', 'g') as body from docs where {_ANCHORED}),
joined as (select doc_id, translate(regexp_replace(regexp_replace(body, '\\r\\n?', chr(10), 'g'), '\\n(?:[ \\t]*\\n)+', chr(1), 'g'), chr(10), ' ') as body from bare),
said as (
  select doc_id, {SENTENCE} as kind, unnest(parts) as body, unnest(generate_series(0, len(parts) - 1)) as pos from (select doc_id, string_split(regexp_replace(body, '([.!?])[ \\t]+', '\\1' || chr(1), 'g'), chr(1)) as parts from joined)
  union all
  select doc_id, {LINE}, unnest(parts), unnest(generate_series(0, len(parts) - 1)) from (select doc_id, regexp_split_to_array(regexp_replace(body, '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), '[\\r\\n]+') as parts from bare)),
stated as (select * from said where ({_ANCHORED}) and not regexp_matches(body, '{NEGATED.replace("'", "''")}')),
units as (
  select * from stated
  union all select doc_id, {NOTICE}, string_agg(body, ' ' order by pos), 0 from stated where kind = {SENTENCE} group by doc_id having count(*) > 1),
ut as (select doc_id, kind, pos, term, count(*) as tf from (select doc_id, kind, pos, unnest({_TOKENS}) as term from units) group by all),
uw as (select doc_id, kind, pos, term, tf * coalesce(idf, {UNSEEN}::double) as w from ut left join idf using (term)),
un as (select doc_id, kind, pos, sqrt(sum(w * w)) as length from uw group by all),
dots as (select doc_id, kind, pos, template, licence, least, sum(w * t) as dot, round(sum(t * t), 6) as held from uw join tu using (term) group by all),
scored as (select doc_id, kind, pos, template, licence, round(dot / length, 6) as score from dots join un using (doc_id, kind, pos) where held > least),
best as (select * from scored where score >= {NEAR} qualify row_number() over (partition by doc_id, kind, pos order by score desc, template) = 1),
unit_words as (select doc_id, kind, pos, sum(tf)::bigint as words from ut group by all),
own as (
  select doc_id, arg_max(licence, (score, -kind, -pos)) as licence, max(score) as score, greatest(coalesce(sum(words) filter (kind = {SENTENCE}), 0), coalesce(sum(words) filter (kind = {LINE}), 0)) as covered
  from best join unit_words using (doc_id, kind, pos) group by doc_id),
speaks as (select dir, licence, score from own join words using (doc_id) where 2 * covered >= len(toks)),
of_dirs as (select dir, licence, score from speaks qualify row_number() over (partition by dir order by score desc, licence) = 1)
select doc_id, path, coalesce(own.licence, d.licence) as licence,
  case when own.licence is not null then 'statement' when d.licence is not null then 'inherited' end as via,
  coalesce(own.score, d.score) as score, case when own.licence is null and d.licence is not null then docs.dir end as declared_in
from docs left join own using (doc_id) left join of_dirs d on d.dir = docs.dir
"""
