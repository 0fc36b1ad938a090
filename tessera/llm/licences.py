"""Licence scans: Dice coefficient over word bigrams, native DataFrame code throughout.

A text is cut into segments at line ends and sentence ends, and, where a sentence goes on over a line end, once more at
sentence ends and blank lines alone, for statements that are wrapped over lines. A segment of several clauses (parts
between commas, colons, semicolons, brackets or quotes) is compared whole and clause by clause, so a statement inside a
longer sentence is found. Segments, clauses and templates are normalised alike: lower case, everything but
letters and digits is a space. The coefficient of two sets of distinct bigrams of sizes a and b with c in common is
2c / (a + b); at least `percent` of it asks for a size between percent / (200 - percent) of the template's and the
inverse. So candidate templates come from an equi-join on size: each template is listed under every size within its
bounds. Before that, a segment must hold one of the template bigrams of which, by the same bounds, no match can do
without all. A segment's characters have no upper bound: blanks, decoration and repetition add no bigrams. Nothing is
shuffled but the matches.

Null, empty and one-word texts match nothing (a template has at least one bigram). Repeated rows, lines and clauses
count each; rows of one id, null included, count together. Templates of one word are ignored. An empty table gives no
rows. Further columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Well-known licence statements, as published.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
PERCENT = 80
_NOT_WORD = r"[^\p{L}\p{N}]+"
#: Every line end inside a sentence is found by the first; what the second parts are clauses.
_WRAPPED, _CLAUSE = r"[^.!?\s]\s*\n\s*\S", r"[,;:()\[\]\"]+"
_BLANK = " \t\n\x0b\f\r"
_FINE, _COARSE = r"\n|(?<=[.!?])[ \t\r]+", r"(?<=[.!?])\s+|\n\s*\n"


def normal_words(text: Column) -> Column:
    """The words of a normalised text; an empty text has one empty word."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), _NOT_WORD, " ")), " ")


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def bounds(size: int, percent: int) -> tuple[int, int]:
    """The least and greatest number of bigrams that a match of a template of `size` can have."""
    return ceil(size * percent / (200 - percent)), size * (200 - percent) // percent


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(licence, template, its bigrams)."""
    rows = spark.createDataFrame([(k, name, text) for k, (name, text) in enumerate(templates)], "template int, licence string, statement string")
    return rows.select("template", "licence", bigrams(normal_words(F.col("statement"))).alias("model")).where("size(model) > 0")


def licence_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id_col, licence, n_segments, dice): the segments that match a licence, and the best coefficient."""
    spark = docs.sparkSession
    models = template_table(spark, templates).collect()  # the templates given, not data
    listed, needles = [], set()
    for row in models:
        size = len(row.model)
        least, most = bounds(size, percent)
        listed += [(n, row.template, row.licence, row.model) for n in range(max(1, least), most + 1)]
        # a match of any size has at least `least` bigrams in common, so it holds one of any size - least + 1 of them
        needles.update(sorted(row.model)[: size - least + 1])
    by_size = spark.createDataFrame(listed, "n int, template int, licence string, model array<string>")
    lowest, highest = min(n for n, *_ in listed), max(n for n, *_ in listed)

    text = F.col("text")
    wrapped = F.filter(F.split(text, _COARSE), lambda s: F.contains(F.btrim(s, F.lit(_BLANK)), F.lit("\n")))
    wrapped = F.when(text.rlike(_WRAPPED), wrapped).otherwise(F.array().cast("array<string>"))
    clauses = F.transform(F.split("segment", _CLAUSE), lambda c: bigrams(normal_words(c)))
    clauses = F.when(F.col("segment").rlike(_CLAUSE), clauses).otherwise(F.array().cast("array<array<string>>"))
    needed = F.arrays_overlap("found", F.array(*(F.lit(x) for x in sorted(needles))))
    segments = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where("text is not null")
        .select("id", F.explode(F.concat(F.split(text, _FINE), wrapped)).alias("segment"))
        .where(F.length("segment") >= 2 * lowest)
        .select("id", "segment", normal_words(F.col("segment")).alias("words"))
        .where(F.size("words") > lowest)
        .select("id", "segment", bigrams(F.col("words")).alias("found"))
        # a clause's bigrams are among its segment's
        .where(F.size("found") >= lowest)
        .where(needed)
        .select("id", F.explode(F.concat(F.array("found"), clauses)).alias("found"))
        .where(F.size("found").between(lowest, highest))
        .where(needed)
        .withColumn("n", F.size("found"))
    )
    common = F.size(F.array_intersect("found", "model"))
    matches = segments.join(by_size, "n").select("id", "licence", "template", common.alias("c"), "n", F.size("model").alias("m")).where(200 * F.col("c") >= percent * (F.col("n") + F.col("m")))
    return matches.groupBy(F.col("id").alias(id_col), "licence").agg(F.count("*").alias("n_segments"), F.max(2.0 * F.col("c") / (F.col("n") + F.col("m"))).alias("dice"))
