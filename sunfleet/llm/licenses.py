"""License scans by diagonal voting, in DataFrame functions only.

Every rolling 3-gram of words of a text is hashed and joined with the positions of the templates' 3-grams. A hit votes
for the diagonal (text position - template position) and says which position of the template it stands for. Neighbouring
diagonals are merged, so that a template with words put in or left out is found as well; a span counts when the positions
of its merged votes cover enough of the template. Spans are then verified: their words are compared with the template's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
K = 3
#: Diagonals so near count as one, and the share of a template's 3-grams that a span needs.
SLACK, COVER = 2, 0.75
# Phrases of the base scan, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Wordings by which public licenses are named or granted, with the labels that the method adds.
WORDINGS = {
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license": "apache-2",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license version 3": "gpl-3",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "this is free and unencumbered software released into the public domain": "unlicense",
}


def templates(spark: SparkSession, phrases: dict[str, str], wordings: dict[str, str]) -> DataFrame:
    """template, label, base, at, hash, n: one row per 3-gram of each template. Its size is that of the two constants."""
    texts = [(i, text, label, i < len(phrases)) for i, (text, label) in enumerate([*phrases.items(), *wordings.items()])]
    if any(not K <= len(text.split(" ")) < K + 63 for _, text, _, _ in texts):
        raise ValueError(f"a template needs {K} to {K + 62} words")
    table = spark.createDataFrame(texts, "template int, text string, label string, base boolean")
    words = F.split("text", " ")
    return table.select("template", "label", "base", (F.size(words) - (K - 1)).alias("n"), F.posexplode(_grams(words)).alias("at", "hash"))


def _grams(words: Column) -> Column:
    hashed = lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, K)])
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (K - 1), F.lit(0))), hashed)


def _folded(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text: Column) -> Column:
    return F.filter(F.split(_folded(text), SEPARATORS), lambda w: w != "")


def _verified(span: Column, words: Column, template: Column) -> Column:
    """The span with what its words say: whether the template stands whole on its diagonal, and the share of the template's
    3-grams that stand on it or on one within SLACK of it."""
    at = lambda i: F.when((i >= 0) & (i + K <= F.size(words)), F.slice(words, i + 1, F.lit(K)))
    near = F.sequence(F.lit(-SLACK), F.lit(SLACK))
    same = lambda i: F.exists(near, lambda d: at(span["start"] + i + d) == F.slice(template, i + 1, F.lit(K)))
    found = F.size(F.filter(F.sequence(F.lit(0), F.size(template) - K), lambda i: F.coalesce(same(i), F.lit(False))))
    whole = F.when(span["start"] >= 0, F.slice(words, span["start"] + 1, F.size(template))) == template
    return F.struct(
        span["template"].alias("template"), span["label"].alias("label"), span["start"].cast("long").alias("start"),
        (span["base"] & F.coalesce(whole, F.lit(False))).alias("exact"), (found / (F.size(template) - (K - 1))).alias("cover"),
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, wordings: dict[str, str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base counts all places of base phrases (overlapping ones too), first_word and last_word are the smallest and largest
    of their starts. labels has the base ones and those of merged spans with COVER of a template; score is the largest
    cover, at most 1. spans is array<struct<template,label,start,exact,cover>>, one for each diagonal that counts.
    Upper-case A-Z is folded. A null or empty text has no words and no labels. Repeated rows give repeated results; null
    ids are ids like others. Extra columns are not read. An empty table gives an empty table. Hashes only pick candidates:
    what is returned comes from the words themselves.
    """
    spark = docs.sparkSession
    phrases, wordings = PHRASES if phrases is None else phrases, WORDINGS if wordings is None else wordings
    table = templates(spark, phrases, wordings)
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("key"))
    # bound to a lambda variable: the text is split once
    grams = F.transform(F.array(_words(F.col("text"))), _grams)[0]
    rows = keyed.select("id", "key", F.posexplode(grams).alias("at", "value"))
    hits = rows.join(F.broadcast(table.select("template", "label", "base", "n", F.col("at").alias("t_at"), "hash")), rows["value"] == F.col("hash"))
    # a diagonal's votes are a set of template positions: equal rows, which vote together, don't add to it
    bit = F.expr("shiftleft(1L, t_at)")
    votes = hits.groupBy("id", "key", "template", "label", "base", "n", (F.col("at") - F.col("t_at")).alias("start")).agg(F.bit_or(bit).alias("votes"))
    near = Window.partitionBy("id", "key", "template").orderBy("start").rangeBetween(-SLACK, SLACK)
    merged = votes.withColumn("near", F.bit_or("votes").over(near))
    candidates = merged.where((F.col("base") & (F.bit_count("votes") == F.col("n"))) | (F.bit_count("near") >= COVER * F.col("n")))
    spans = candidates.groupBy("id", "key").agg(F.collect_list(F.struct("template", "label", "base", "start")).alias("spans"))
    texts = F.array(*[F.array(*[F.lit(w) for w in t.split(" ")]) for t in [*phrases, *wordings]])
    own = F.struct("text", F.coalesce("spans", F.expr("array()").cast(spans.schema["spans"].dataType)).alias("spans"))
    read = F.transform(
        F.array(own),
        lambda row: F.transform(
            F.array(_words(row["text"])),
            lambda words: F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.filter(
                    F.transform(row["spans"], lambda s: _verified(s, words, F.get(texts, s["template"]))),
                    lambda s: s["exact"] | (s["cover"] >= COVER),
                ).alias("spans"),
            ),
        )[0],
    )[0]
    spans = spans.withColumnsRenamed({"id": "id_", "key": "key_"})
    out = keyed.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("key") == F.col("key_")), "left").select("id", read.alias("read"))
    out = out.select("id", "read.n_words", F.array_sort("read.spans").alias("spans"))
    exact = F.filter("spans", lambda s: s["exact"])
    starts = F.transform(exact, lambda s: s["start"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda s: s["label"]))), ",")
    return out.select(
        F.col("id").alias(doc_id), "n_words", F.size(exact).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(exact).alias("base_labels"), joined(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"), "spans",
    )


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _values(texts: dict[str, str], base: bool) -> str:
    return ", ".join(f"('{text}', '{label}', {str(base).lower()})" for text, label in texts.items())


#: The base columns by direct comparison of words, the method's by the template positions that 3-grams vote for.
OP8_SQL = f"""
WITH t AS (SELECT text, label, base, string_split(text, ' ') AS parts FROM (VALUES {_values(PHRASES, True)}, {_values(WORDINGS, False)}) AS v(text, label, base)),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SEPARATORS}'), lambda x: x <> '') AS words FROM documents),
exact AS (SELECT doc_id, label, unnest(list_filter(range(1, len(words) - len(parts) + 2), lambda i: words[i:i + len(parts) - 1] = parts)) - 1 AS start FROM w, t WHERE base),
tg AS (SELECT text, label, base, len(parts) - {K - 1} AS n, unnest(list_transform(range(1, len(parts) - {K - 2}), lambda i: {{'at': i, 'gram': array_to_string(parts[i:i + {K - 1}], ' ')}})) AS g FROM t),
wg AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - {K - 2}), lambda i: {{'at': i, 'gram': array_to_string(words[i:i + {K - 1}], ' ')}})) AS g FROM w),
votes AS (SELECT doc_id, text, label, base, n, wg.g.at - tg.g.at AS diagonal, bit_or(1::BIGINT << (tg.g.at - 1)::INT) AS votes FROM wg JOIN tg ON wg.g.gram = tg.g.gram GROUP BY ALL),
merged AS (SELECT *, bit_count(bit_or(votes) OVER (PARTITION BY doc_id, text ORDER BY diagonal RANGE BETWEEN {SLACK} PRECEDING AND {SLACK} FOLLOWING)) AS near FROM votes),
spans AS (SELECT doc_id, list_sort(list_distinct(list(label))) AS labels, max(near / n)::DOUBLE AS score FROM merged WHERE near / n >= {COVER} GROUP BY doc_id),
bases AS (SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM exact GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bases.labels, ','), '') AS base_labels, coalesce(array_to_string(spans.labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM w LEFT JOIN bases USING (doc_id) LEFT JOIN spans USING (doc_id)"""
