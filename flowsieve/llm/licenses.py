"""License scans by diagonal voting, in DataFrame functions only.

Every run of k words of a document is hashed and joined with the positions of the same run in
license templates (a small table, broadcast after a check of its size). A hit lies on the diagonal
``document position - template position``; hits are counted by (document, template,
diagonal), neighbouring diagonals are merged (a word inserted or left out moves the rest of a notice
by one), and a merged span is kept if its words were compared and cover enough of the template.

Scale: texts are never shuffled. Only hits (a handful for each license line) and one short row
per document are; a notice in a third of all documents is spread by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowsieve.llm.common import pick

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_TEMPLATE_RUNS = 100_000  # bound of the broadcast table

# The phrases of the base, and public license notices as templates.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
TEMPLATES = {
    "mit-notice": ["Released under the MIT License",
                   "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0",
                   "you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
}


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; null: none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), SEPARATORS), "")


def runs_of(words: Column, k: int) -> Column:
    """All runs of k words, joined by spaces, in order."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    run = F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
    return F.when(F.size(words) >= k, run).otherwise(F.array().cast("array<string>"))


def template_runs(spark: SparkSession, templates: dict, k: int) -> DataFrame:
    """(template, label, t_pos, run, digest, t_runs)."""
    rows = [(i, label, text) for i, (label, text) in enumerate((label, t) for label, texts in templates.items() for t in texts)]
    t = spark.createDataFrame(rows, "template int, label string, text string").withColumn("w", words_of(F.col("text")))
    t = t.select("template", "label", runs_of(F.col("w"), k).alias("r"))
    t = t.select("template", "label", F.size("r").alias("t_runs"), F.posexplode("r").alias("t_pos", "run"))
    return t.withColumn("digest", F.xxhash64("run"))


def phrase_starts(words: Column, phrase: str) -> Column:
    """Positions at which the phrase's words stand consecutively; looked for only where its last
    word occurs at all."""
    parts = phrase.split(" ")

    def stands(i):
        hit = F.get(words, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            hit = hit & (F.get(words, i + j) == p)
        return hit
    some = F.array_contains(words, parts[-1]) & (F.size(words) >= len(parts))
    return F.when(some, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)).otherwise(F.array().cast("array<int>"))


def diagonal_spans(docs: DataFrame, key: list[str], text: Column, templates=None, k: int = 3, gap: int = 2, least: float = 0.8) -> DataFrame:
    """Verified spans: key columns, label, first_word, last_word (exclusive), coverage."""
    spark = docs.sparkSession
    t = template_runs(spark, templates or TEMPLATES, k)
    if t.count() > MAX_TEMPLATE_RUNS:
        raise ValueError("too many template runs to broadcast")
    runs = (docs.select(*key, words_of(text).alias("w")).select(*key, F.posexplode(runs_of(F.col("w"), k)).alias("pos", "run"))
            .withColumn("digest", F.xxhash64("run")))
    # the hash finds the place, the words confirm it
    hits = runs.join(F.broadcast(t.withColumnRenamed("run", "t_run")), "digest").where(F.col("run") == F.col("t_run"))
    diagonals = (hits.groupBy(*key, "template", "label", "t_runs", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
                 .agg(F.collect_set("t_pos").alias("found"), F.min("pos").alias("first"), F.max("pos").alias("last")))
    w = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.when(F.col("diagonal") - F.lag("diagonal").over(w) <= gap, 0).otherwise(1)
    groups = diagonals.withColumn("apart", apart).withColumn("span", F.sum("apart").over(w))
    spans = groups.groupBy(*key, "template", "label", "t_runs", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("n"), F.min("first").alias("first_word"),
        (F.max("last") + k).alias("last_word"))
    return (spans.withColumn("coverage", F.col("n") / F.col("t_runs")).where(F.col("coverage") >= least)
            .select(*key, "label", "first_word", "last_word", "coverage"))


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=None, phrases=None, **options) -> DataFrame:
    """Per row: id, n_words, n_base (places of the base phrases), first_word and last_word (their
    smallest and largest start, else null), base_labels, labels (base and verified spans; both
    distinct, sorted, comma-joined, empty if none), score: the best coverage of a verified span,
    0.5 for base places without one, else 0.

    Null and empty texts have no words. Rows are told apart by (id, hash of the text), so repeated
    rows get equal results and a null id is an id like any other; no rows give no rows; other
    columns play no part."""
    d = pick(docs, _id=id_col, _text=text_col).select("_id", F.xxhash64("_text").alias("_digest"), "_text")
    phrases = phrases or PHRASES
    w = F.col("_w")
    base = (d.select("_id", "_digest", words_of(F.col("_text")).alias("_w"))
            .select("_id", "_digest", F.size(w).cast("long").alias("n_words"), *[phrase_starts(w, p).alias(f"_p{i}") for i, p in enumerate(phrases)]))
    starts = F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(v)) for i, v in enumerate(phrases.values())]))
    base = base.select("_id", "_digest", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
                       F.array_max(starts).cast("long").alias("last_word"), F.array_sort(F.array_distinct(labels)).alias("_base"))
    spans = diagonal_spans(d, ["_id", "_digest"], F.col("_text"), templates, **options)
    best = spans.groupBy("_id", "_digest").agg(F.collect_set("label").alias("_found"), F.max("coverage").alias("_cover"))
    best = best.select(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), "_found", "_cover")
    j = base.join(best, base["_id"].eqNullSafe(best["_i"]) & (base["_digest"] == best["_d"]), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return j.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"),
                    F.array_join(every, ",").alias("labels"),
                    F.coalesce("_cover", F.when(F.col("n_base") > 0, F.lit(0.5)), F.lit(0.0)).cast("double").alias("score"))
