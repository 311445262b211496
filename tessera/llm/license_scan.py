"""Operator 13, license scans by diagonal voting, in DataFrame operations only.

Templates are short phrases (``base``) and license notices. Every document's
words are read once; the hashes of all its word k-grams (k is ``GRAM``, or all
of a shorter template) are joined to the positions at which templates hold the
same gram, and the words themselves are compared, so that no collision counts.
Each match votes for a diagonal, its place in the document less its place in
the template. Votes are aggregated by diagonal; a notice's diagonals at most
``SLACK`` words apart (words put in or left out of a copy) are merged to one
span, a phrase's are places of their own. A span is verified when the grams
that it really holds cover ``COVER`` of the template's words.

Nothing but votes, and one row a document, leaves the tasks that read texts.

Defined results: null or empty texts, and texts without a word, have no words,
places or labels and score 0; repeated rows are judged alike and repeat, rows
of one id but different texts apart; templates without a word match nothing;
equal templates count once each; empty tables give an empty result or no
labels. Columns besides the named ones are not read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import bounded_broadcast, prepare, stage, text_of
from tessera.llm.decontaminate import words

GRAM, SLACK, COVER = 4, 3, 0.6
#: ends every document's words, and stands for the document among the votes
_END = "\x00"

# fixed values: the phrases of the contract, and the wording of public license notices
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
NOTICES = [
    ("agpl", "GNU Affero General Public License as published by the Free Software Foundation"),
    ("apache", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of '
               'the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("apache", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES '
               'OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
            "notice and this permission notice appear in all copies."),
    ("lgpl", "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in '
            'the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of '
            'the Software, and to permit persons to whom the Software is furnished to do so'),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def templates_table(spark: SparkSession, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """``label, base, text`` rows of phrases and notices."""
    rows = [(a, True, t) for a, t in phrases] + [(a, False, t) for a, t in notices]
    if not rows:
        return spark.range(0).select(F.lit("").alias("label"), F.lit(True).alias("base"), F.lit("").alias("text"))
    each = [F.struct(F.lit(a).alias("label"), F.lit(b).alias("base"), F.lit(t).alias("text")) for a, b, t in rows]
    return spark.range(1).select(F.inline(F.array(*each)))


def template_grams(templates: DataFrame, gram: int = GRAM) -> DataFrame:
    """``tid, label, base, size, k, at, gram``: each template's word k-grams and
    their places; ``tid`` is the template's place in the order of its columns."""
    order = Window.orderBy(F.col("base").desc(), "label", "text")
    t = (templates.select("label", "base", "text", words("text").alias("w")).filter(F.size("w") > 0)
         .select("label", "base", "w", F.row_number().over(order).alias("tid"), F.size("w").alias("size")))
    t = t.withColumn("k", F.least("size", F.lit(gram)))
    return (t.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("k"))))
            .select("tid", "label", "base", "size", "k", "at", F.slice("w", F.col("at") + 1, F.col("k")).alias("gram")))


def _hash(parts: list[Column]) -> Column:
    return F.xxhash64(*parts)


def votes(docs: DataFrame, grams: DataFrame, n_grams: int, sizes: list[int], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, h, pos, tid, at``: the places where a document holds a
    template's gram, and one row of ``tid`` -1 a document, whose ``pos`` is its
    word count. ``h`` is the text's hash, so that rows of one id stay apart."""
    known = grams.select("tid", "at", "k", "gram").withColumn(
        "hash", F.coalesce(*[F.when(F.col("k") == n, _hash([F.get("gram", F.lit(i)) for i in range(n)])) for n in sizes]) if sizes else F.lit(0).cast("long"))
    end = docs.sparkSession.range(1).select(F.lit(-1).alias("tid"), F.lit(0).alias("at"), F.lit(1).alias("k"), F.array(F.lit(_END)).alias("gram"), _hash([F.lit(_END)]).alias("hash"))
    known = known.unionByName(end)
    each = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text_of(text)).alias("h"), F.concat(words(text), F.array(F.lit(_END))).alias("w"))
    each = each.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "word"))
    inside = F.size("w") - 1 - F.col("pos")  # words from here to the end
    hashes = [F.when(inside >= n, _hash([F.get("w", F.col("pos") + i) for i in range(n)])) for n in sizes]
    last = F.when(inside == 0, _hash([F.col("word")]))
    each = each.select("doc_id", "h", "w", "pos", F.explode(F.array(*hashes, last)).alias("hash"))
    met = each.join(bounded_broadcast(known, n_grams), "hash").filter(F.slice("w", F.col("pos") + 1, F.col("k")) == F.col("gram"))
    return met.select("doc_id", "h", "pos", "tid", "at")


def spans_of(found: DataFrame, grams: DataFrame, n_grams: int, slack: int = SLACK, cover: float = COVER) -> DataFrame:
    """``doc_id, h, tid, label, base, start, end, covered, size, share,
    verified`` of every span (``end`` is the word after it)."""
    kinds = grams.select("tid", "label", "base", "size", "k").distinct()
    doc = ["doc_id", "h", "tid"]
    diagonals = (found.filter("tid > 0").withColumn("diagonal", F.col("pos") - F.col("at"))
                 .groupBy(*doc, "diagonal").agg(F.sort_array(F.collect_set("at")).alias("hits")))  # places in one template
    diagonals = diagonals.join(bounded_broadcast(kinds, n_grams), "tid")
    by = Window.partitionBy(*doc).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by)
    fresh = F.coalesce(apart > F.least(F.lit(slack), F.col("size") - F.col("k")), F.lit(True))
    diagonals = diagonals.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(by))
    reached = F.flatten(F.transform("hits", lambda t: F.sequence(t, t + F.col("k") - 1)))
    spans = (diagonals.select(*doc, "span", "label", "base", "size", "diagonal", "hits", "k", reached.alias("reached"))
             .groupBy(*doc, "span", "label", "base", "size")
             .agg(F.min(F.col("diagonal") + F.array_min("hits")).alias("start"), F.max(F.col("diagonal") + F.array_max("hits") + F.col("k")).alias("end"),
                  F.size(F.array_distinct(F.flatten(F.collect_list("reached")))).alias("covered")))
    share = F.col("covered") / F.col("size")
    return spans.drop("span").withColumns({"share": share, "verified": share >= cover})


def scan(docs: DataFrame, templates: DataFrame, text: str = "text", key: str = "doc_id", gram: int = GRAM, slack: int = SLACK, cover: float = COVER) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score`` of every row of ``docs``, and all spans. ``score`` is the largest
    share of a template that a span covers."""
    prepare(docs.sparkSession)
    grams = stage(template_grams(templates, gram), "grams")
    n_grams, sizes = grams.agg(F.count(F.lit(1)), F.sort_array(F.collect_set("k"))).first()  # at most ``gram`` sizes
    found = stage(votes(docs, grams, n_grams + 1, sizes, text, key), "votes")
    spans = stage(spans_of(found, grams, n_grams, slack, cover), "spans")
    base = F.col("base")
    per = spans.groupBy("doc_id", "h").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"), F.array_sort(F.collect_set(F.when(F.col("verified"), F.col("label")))).alias("labels"),
        F.max("share").alias("score")).withColumnsRenamed({"doc_id": "f_id", "h": "f_h"})
    rows = found.filter("tid = -1").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))
    out = rows.join(per, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"),
                      F.col("last_word").cast("long").alias("last_word"), F.coalesce(F.array_join("base_labels", ","), F.lit("")).alias("base_labels"),
                      F.coalesce(F.array_join("labels", ","), F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score")), spans


def _oracle() -> str:
    def quoted(t: str) -> str:
        return "'" + t.replace("'", "''") + "'"

    def cut(column: str) -> str:
        return (rf"regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
                r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

    rows = ", ".join(f"({i}, {quoted(a)}, {b}, {quoted(t)})" for i, (a, b, t) in enumerate([(a, "true", t) for a, t in PHRASES] + [(a, "false", t) for a, t in NOTICES]))
    return f"""
WITH t AS (SELECT tid, label, base, w, len(w) AS size, least(len(w), {GRAM}) AS k FROM (SELECT *, {cut('text')} AS w FROM (VALUES {rows}) v(tid, label, base, text))),
g AS (SELECT tid, label, base, size, k, off, array_to_string(w[off + 1:off + k], ' ') AS gram FROM (SELECT *, unnest(range(size - k + 1)) AS off FROM t)),
d AS MATERIALIZED (SELECT doc_id, {cut('text')} AS w FROM documents),
e AS (SELECT doc_id, w, unnest(range(len(w))) AS pos FROM d),
v AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + n], ' ') AS gram, n FROM e, (SELECT DISTINCT k AS n FROM t) WHERE pos + n <= len(w)),
m AS MATERIALIZED (SELECT doc_id, tid, label, base, size, k, pos, off, pos - off AS diagonal FROM v JOIN g USING (gram)),
f AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER x <= least({SLACK}, size - k) THEN 0 ELSE 1 END AS fresh
    FROM (SELECT DISTINCT doc_id, tid, size, k, diagonal FROM m) WINDOW x AS (PARTITION BY doc_id, tid ORDER BY diagonal)),
s AS (SELECT doc_id, tid, diagonal, sum(fresh) OVER (PARTITION BY doc_id, tid ORDER BY diagonal) AS span FROM f),
c AS (SELECT doc_id, tid, label, base, size, span, min(pos) AS start, count(DISTINCT r) AS covered
    FROM (SELECT *, unnest(range(off, off + k)) AS r FROM m JOIN s USING (doc_id, tid, diagonal)) GROUP BY ALL),
p AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (covered / size >= {COVER}) AS labels,
    max(covered / size) AS score FROM c GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN p USING (doc_id)
"""


#: the registered query's rows in DuckDB SQL, grams compared as text (ids taken to be unique)
ORACLE_SQL = _oracle()
