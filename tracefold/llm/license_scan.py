"""License scan by diagonal voting.

Every rolling pair of neighbouring words (the k-gram; the shortest phrase has two words) is
hashed and joined with the places of the same pair in license templates.  A hit at document
word ``i`` and template word ``j`` votes for the diagonal ``i - j``: an unchanged copy puts all
its votes on one diagonal, a copy with words put in or left out on a few neighbouring ones.
Votes are added up per diagonal before any shuffle as a 64-bit mask of the template places
that were hit, so a row has the same size however often a template occurs.

* A phrase stands at a place when its diagonal holds all votes.  The join compares the words
  and not only their hashes, so such a place is exact.
* Longer templates keep diagonals with :data:`MIN_VOTES` votes, merge neighbours not more than
  :data:`SLACK` words apart, and hold when the merged span covers :data:`SHARE` of the template
  without being longer than :data:`STRETCH` times it.

Everything is DataFrame functions: one scan, one broadcast join with the fixed template table
(hundreds of rows, independent of the data) and aggregates of about one row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_VOTES = 3
SLACK = 3
SHARE = 0.8
STRETCH = 1.5

# Phrases that count as base places.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further phrases with labels of their own.
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "bsd license": "bsd",
    "isc license": "isc",
    "zlib license": "zlib",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "spdx license identifier apache": "apache",
    "spdx license identifier mit": "mit",
    "spdx license identifier gpl": "gpl",
    "spdx license identifier bsd": "bsd",
}
# Opening sentences of well-known licenses, at most 65 words each.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software "
    "and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in "
    "compliance with the license you may obtain a copy of the license at": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the "
    "gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted "
    "provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without "
    "fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this software is provided as is without any express or implied warranty in no event will the "
    "authors be held liable for any damages arising from the use of this software": "zlib",
    "this work is licensed under a creative commons attribution": "cc-by",
}
BASE_KIND, PHRASE_KIND, TEXT_KIND = 0, 1, 2


def templates() -> list[tuple[int, str, int, list[str]]]:
    """(template, label, kind, words) of all templates; at most 64 word pairs each."""
    kinds = ((BASE, BASE_KIND), (PHRASES, PHRASE_KIND), (TEXTS, TEXT_KIND))
    rows = [(text, label, kind) for table, kind in kinds for text, label in table.items()]
    out = [(i, label, kind, text.split(" ")) for i, (text, label, kind) in enumerate(rows)]
    assert all(2 <= len(words) <= 65 for *_, words in out)
    return out


def pair_values() -> str:
    """Every word pair of the templates as SQL rows."""
    return ",\n  ".join(f"({t}, '{label}', {kind}, {len(words) - 1}, {j}, '{words[j]}', '{words[j + 1]}')"
                        for t, label, kind, words in templates() for j in range(len(words) - 1))


def template_pairs(spark) -> DataFrame:
    """(template, label, kind, pairs, place, left, right, gram): a fixed local table."""
    return spark.sql(f"SELECT * FROM VALUES {pair_values()} "
                     "AS t(template, label, kind, pairs, place, left, right)").withColumn(
        "gram", F.xxhash64("left", "right"))


def votes(docs: DataFrame) -> DataFrame:
    """One row per document, template and diagonal with the mask of template places hit.

    Documents without a hit keep one row whose ``template`` is null.
    """
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    n = F.size("words")
    pairs = split.select(
        "row", "doc_id", "words", n.cast("long").alias("n_words"),
        F.explode_outer(F.when(n > 1, F.sequence(F.lit(0), n - 2))).alias("at"))
    left, right = F.get("words", F.col("at")), F.get("words", F.col("at") + 1)
    known = F.broadcast(template_pairs(docs.sparkSession))  # a fixed table of the library
    hits = pairs.join(known, (F.xxhash64(left, right) == F.col("gram")) & (left == F.col("left"))
                      & (right == F.col("right")), "left")
    return hits.groupBy("row", "doc_id", "n_words", "template", "label", "kind", "pairs",
                        (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))


def low_bit(mask: Column) -> Column:
    """Number of the lowest set bit."""
    return F.bit_count(mask.bitwiseAND(-mask) - F.lit(1))


def high_bit(mask: Column) -> Column:
    """Number of the highest set bit."""
    return F.length(F.bin(mask)) - F.lit(1)


def spans(docs: DataFrame) -> DataFrame:
    """One row per place or verified span (see the module's text), and one for documents without.

    Columns: row, doc_id, n_words, template, label, kind, start, stop (word numbers, ``stop``
    exclusive), share (of the template's word pairs found) and holds.  Null and empty texts
    have no words; an empty table gives no rows; repeated rows are answered each, other
    columns are ignored.
    """
    strong = (F.col("kind") == TEXT_KIND) & (F.bit_count("mask") >= MIN_VOTES)
    whole = (F.col("kind") != TEXT_KIND) & (F.bit_count("mask") == F.col("pairs"))
    kept = votes(docs).withColumn("keep", F.coalesce(strong | whole, F.lit(False)))
    of_template = W.partitionBy("row", "template", "keep").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(of_template)
    opens = (F.col("kind") != TEXT_KIND) | gap.isNull() | (gap > SLACK)
    runs = kept.withColumn("opens", F.when(F.col("keep") & opens, 1).otherwise(0)).withColumn(
        "run", F.sum("opens").over(of_template.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "doc_id", "n_words", "template", "label", "kind", "pairs", "keep", "run").agg(
        F.bit_or("mask").alias("mask"),
        F.min(F.col("diagonal") + low_bit(F.col("mask"))).alias("start"),
        F.max(F.col("diagonal") + high_bit(F.col("mask")) + 2).alias("stop"))
    share = F.bit_count("mask") / F.col("pairs")
    holds = F.col("keep") & (share >= SHARE) & (
        F.col("stop") - F.col("start") <= F.lit(STRETCH) * (F.col("pairs") + 1))
    return merged.select("row", "doc_id", "n_words", "template", "label", "kind", "start", "stop",
                         F.when(F.col("keep"), share).alias("share"),
                         F.coalesce(holds, F.lit(False)).alias("holds"))


def license_scan(docs: DataFrame) -> DataFrame:
    """Per document the base places, all labels, and the largest share of a template found."""
    base = F.col("holds") & (F.col("kind") == BASE_KIND)

    def joined(condition: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(condition, F.col("label")))), ",")

    return spans(docs).groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("holds")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score")).drop("row")


def sql() -> str:
    """DuckDB SQL of :func:`license_scan`."""
    return f"""
WITH pair(template, label, kind, pairs, place, l, r) AS (VALUES
  {pair_values()}),
doc AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
          translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
word AS (SELECT rid, unnest(w[:-2]) AS l, unnest(w[2:]) AS r, unnest(range(0, len(w) - 1)) AS i
         FROM doc WHERE len(w) > 1),
vote AS (SELECT rid, template, label, kind, pairs, i - place AS diagonal,
                bit_or(1::UBIGINT << place::UBIGINT) AS mask, min(i) AS lo, max(i) + 2 AS hi
         FROM word JOIN pair USING (l, r) GROUP BY ALL),
kept AS (SELECT * FROM vote WHERE (kind = {TEXT_KIND} AND bit_count(mask) >= {MIN_VOTES})
                               OR (kind <> {TEXT_KIND} AND bit_count(mask) = pairs)),
opened AS (SELECT *, CASE WHEN kind <> {TEXT_KIND} OR coalesce(diagonal - lag(diagonal) OVER p, {SLACK + 1}) > {SLACK}
                     THEN 1 ELSE 0 END AS opens FROM kept WINDOW p AS (PARTITION BY rid, template ORDER BY diagonal)),
run AS (SELECT *, sum(opens) OVER (PARTITION BY rid, template ORDER BY diagonal
                                   ROWS UNBOUNDED PRECEDING) AS run FROM opened),
span AS (SELECT rid, label, kind, bit_count(bit_or(mask)) / pairs::DOUBLE AS share, min(lo) AS s, max(hi) AS e,
                any_value(pairs) AS n FROM run GROUP BY rid, template, label, kind, pairs, run),
held AS (SELECT *, share >= {SHARE} AND e - s <= {STRETCH} * (n + 1) AS holds FROM span),
found AS (SELECT rid, count(*) FILTER (holds AND kind = {BASE_KIND}) AS n_base,
                 min(s) FILTER (holds AND kind = {BASE_KIND}) AS first_word,
                 max(s) FILTER (holds AND kind = {BASE_KIND}) AS last_word,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (holds AND kind = {BASE_KIND}))), ',') AS base_labels,
                 array_to_string(list_sort(list_distinct(list(label) FILTER (holds))), ',') AS labels,
                 max(share) AS score
          FROM held GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM doc LEFT JOIN found USING (rid)"""
