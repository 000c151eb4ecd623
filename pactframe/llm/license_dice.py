"""Licence notices in texts, by Dice coefficient over word bigrams.

Sentences, also across line breaks, lines and paragraphs are compared with
licence templates in normalised form.  Two facts prune without loss: a passage far smaller or
larger than a template cannot reach the coefficient, and one that reaches it
holds at least one of any choice of more than (2 - 2t)/(2 - t) of the
template's bigrams.  Only DataFrame functions are used.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pactframe.llm.common import without
from pactframe.sources.tables import stored

LEAST_DICE = 0.8
BROADCAST_BIGRAMS = 50_000  # more template bigrams than that are joined by a shuffle

# Usual notices of common licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
    "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to '
    "use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
    "the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_bigrams(bigrams: list[str], least: float) -> list[str]:
    """The longest bigrams, as many as no passage at the coefficient can lack altogether."""
    lacking = int(len(bigrams) * (2 - 2 * least) / (2 - least) + 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: lacking + 1]


def may_hold_notice(small: Column, texts: dict[str, str], least: float) -> Column:
    """Whether a text in small letters holds a telling bigram of any template.

    The plain search for the longer word of each comes first and spares most
    texts the pattern.
    """
    chosen = sorted({b for t in texts.values() for b in telling_bigrams(template_bigrams(t), least)})
    if not chosen:
        return F.lit(False)
    words = sorted({max(b.split(), key=len) for b in chosen})
    pattern = "(?<![a-z0-9])(?:" + "|".join(b.replace(" ", "[^a-z0-9]+") for b in chosen) + ")(?![a-z0-9])"
    return reduce(or_, (F.contains(small, F.lit(w)) for w in words)) & small.rlike(pattern)


def wrapped_passages(text: Column, most: int) -> Column:
    """Sentences across line breaks, runs of up to ``most`` of them, and paragraphs that lines of comment marks part.

    Marks at the start of a line are no words, so they need not be taken off.
    Single sentences within a line are left to the other levels.
    """

    def runs(sentences: Column) -> Column:
        found = [F.filter(sentences, lambda p: F.contains(p, F.lit("\n")))]
        for k in range(2, most + 1):
            further = range(1, k)
            # those beyond the last sentence are null, which concat_ws leaves out
            found.append(F.transform(sentences, lambda p, i: F.concat_ws(" ", p, *[F.get(sentences, i + j) for j in further])))
        return F.concat(*found)

    def of_paragraph(paragraph: Column) -> Column:
        # the array of one makes the sentences a variable, so that they are split once
        split = F.array(F.split(paragraph, r"(?<=[.!?;:])\s+"))
        return F.concat(F.array(paragraph), F.flatten(F.transform(split, runs)))

    return F.flatten(F.transform(F.split(text, r"\n[^\p{L}\p{N}\n]*\n"), of_paragraph))


def passages(text: Column, most: int = 1) -> Column:
    """Sentences, lines, paragraphs and wrapped sentences of a text, each with its level."""
    sentences = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), "\n")
    levels = ((0, sentences), (1, F.split(text, "\n")), (2, F.split(text, r"\n[ \t]*\n")), (3, wrapped_passages(text, most)))

    def at(level: int, parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct(F.lit(level).alias("level"), i.alias("n"), p.alias("passage")))

    return F.concat(*[at(level, parts) for level, parts in levels])


def normalised_words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(license, template_size, bigram), a row per bigram of each template."""
    rows = [(name, len(b), x) for name, t in texts.items() for b in [template_bigrams(t)] for x in b]
    return spark.createDataFrame(rows, "license string, template_size int, bigram string")


def find_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None,
                  least: float = LEAST_DICE) -> DataFrame:
    """(key, license, dice, n_passages) of every licence whose notice is in a document.

    A passage counts for the templates at which it has the highest coefficient,
    if that is ``least`` or more; ``n_passages`` counts its sentences within
    lines, and ``dice`` is the highest of any passage.  Null and empty texts have no
    licence, nor have templates of one word.  Rows are told apart by a number
    given when they are written, so repeated rows give repeated results.
    """
    texts = TEMPLATES if texts is None else texts
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).withColumn("small", F.lower("text"))
    maybe = rows.where(may_hold_notice(F.col("small"), texts, least))
    maybe = stored(maybe.select("key", "text").withColumn("row", F.monotonically_increasing_id()), "license-texts")
    sizes = [len(template_bigrams(t)) for t in texts.values()]
    smallest, largest = min(sizes, default=0) * least / (2 - least), max(sizes, default=0) * (2 - least) / least
    most = max((len(re.split(r"(?<=[.!?;:])\s+", t)) for t in texts.values()), default=1)
    parts = maybe.select("row", F.explode(passages(F.col("text"), most)).alias("p")).select("row", "p.level", "p.n", normalised_words(F.col("p.passage")).alias("w"))
    # a passage of k distinct bigrams has more than k words; repeats only make it longer
    parts = parts.where(F.size("w") > smallest)
    last = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("w", F.lit(1), last), F.slice("w", F.lit(2), last), lambda a, b: F.concat(a, F.lit(" "), b))
    parts = parts.withColumn("bigrams", F.array_distinct(pairs)).withColumn("size", F.size("bigrams")).where(F.col("size").between(smallest, largest))
    known = sorted({b for t in texts.values() for b in template_bigrams(t)})
    shared = parts.select("row", "level", "n", "size", F.explode(F.array_intersect("bigrams", F.array(*map(F.lit, known)))).alias("bigram"))
    listed = templates(docs.sparkSession, texts)
    # a few hundred bigrams of the given templates, whatever the documents
    met = shared.join(F.broadcast(listed) if len(known) <= BROADCAST_BIGRAMS else listed, "bigram")
    fits = (F.col("size") >= F.col("template_size") * (least / (2 - least)) - 1e-9) & (F.col("size") <= F.col("template_size") * ((2 - least) / least) + 1e-9)
    scored = (
        met.where(fits).groupBy("row", "level", "n", "size", "license", "template_size").agg(F.count("*").alias("common"))
        .withColumn("dice", 2.0 * F.col("common") / (F.col("size") + F.col("template_size"))).where(F.col("dice") >= least)
    )
    best = scored.groupBy("row", "level", "n").agg(F.max("dice").alias("dice"))
    chosen = scored.join(best, ["row", "level", "n", "dice"]).groupBy("row", "license").agg(
        F.max("dice").alias("dice"), F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("n_passages"))
    return chosen.join(maybe.select("row", "key"), "row").select(F.col("key").alias(key), "license", "dice", "n_passages")


def with_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with ``licenses``, the sorted names found for their key; same-named input columns are replaced."""
    found = find_licenses(docs, key, text).groupBy(key).agg(F.array_sort(F.collect_set("license")).alias("licenses"))
    rows = without(docs, "licenses").join(found, key, "left")
    return rows.withColumn("licenses", F.coalesce("licenses", F.array().cast("array<string>")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Every passage of every document against every template, without any pruning.
ORACLE = f"""
with templates(license, body) as (values {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in TEMPLATES.items())}),
tw as (select license, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') as w from templates),
tb as (select distinct license, w[i] || ' ' || w[i + 1] as bigram from tw, unnest(generate_series(1, len(w) - 1)) as g(i)),
ts as (select license, count(*) as template_size from tb group by license),
p as (
  select doc_id, 0 as level, unnest(string_split(regexp_replace(text, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) as passage,
    generate_subscripts(string_split(regexp_replace(text, '([.!?;:])[ \\t]+', '\\1' || chr(10), 'g'), chr(10)), 1) as n from documents
  union all select doc_id, 1, unnest(string_split(text, chr(10))), generate_subscripts(string_split(text, chr(10)), 1) from documents
  union all select doc_id, 2, unnest(string_split_regex(text, '\\n[ \\t]*\\n')), generate_subscripts(string_split_regex(text, '\\n[ \\t]*\\n'), 1) from documents),
pw as (select doc_id, level, n, string_split(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), ' ') as w from p),
pb as (select distinct doc_id, level, n, w[i] || ' ' || w[i + 1] as bigram from pw, unnest(generate_series(1, len(w) - 1)) as g(i)),
ps as (select doc_id, level, n, count(*) as size from pb group by all),
c as (select pb.doc_id, pb.level, pb.n, tb.license, count(*) as common from pb join tb using (bigram) group by all),
s as (select c.doc_id, c.level, c.n, c.license, 2.0::double * common / (size + template_size) as dice
  from c join ps using (doc_id, level, n) join ts using (license)),
b as (select *, max(dice) over (partition by doc_id, level, n) as top from s where dice >= {LEAST_DICE})
select doc_id, license, max(dice) as dice, count(*) filter (where level = 0) as n_passages from b where dice = top group by doc_id, license
"""
