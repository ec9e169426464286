"""License scan by diagonal voting, in DataFrame functions only.

All word k-grams of a text are hashed and joined to the k-gram positions of the templates. A hit at word i of the text
and word j of a template votes for the diagonal i - j. Votes are counted for each document, template and diagonal, and
diagonals that lie within `slack` words are merged, so that inserted or lost words do not split a match. Hits are
verified word by word. A phrase template (the base) counts where one diagonal holds all its k-grams. A band of a text
template is verified as a span: only hits in common order count, each place of the template once, found by going through
the hits by word and keeping the longest chain of rising places; it gives its label where the chain holds at least
`coverage` of the template's k-grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm._shared import ascii_lower, stored, words_of

K = 3
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices and opening paragraphs of public licenses.
TEXTS = {
    "gpl": ["licensed under the gnu general public license version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license version"],
    "agpl": ["licensed under the gnu affero general public license version"],
    "mit-text": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"],
    "apache-2-text": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["this work is licensed under a creative commons attribution"],
}


def templates(spark: SparkSession, phrases: dict[str, str] | None = None, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """(h, tid, label, base, j, gram, n_grams): a row for each k-gram of each template; a few hundred rows, fixed in the code."""
    listed = [(p, label, True) for p, label in (PHRASES if phrases is None else phrases).items()] + [(t, label, False) for label, many in (TEXTS if texts is None else texts).items() for t in many]
    rows = []
    for tid, (words, label, base) in enumerate((t.split(), label, base) for t, label, base in listed):
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {' '.join(words)}")
        rows += [(tid, label, base, j, words[j : j + K], len(words) - K + 1) for j in range(len(words) - K + 1)]
    made = spark.createDataFrame(rows, "tid int, label string, base boolean, j int, gram array<string>, n_grams int")
    return made.withColumn("h", F.xxhash64(*[F.get("gram", F.lit(k)) for k in range(K)]))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, i, tid, label, base, j, n_grams): verified k-gram hits, and for each row of docs at least one row (null tid)."""
    at = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words_of(ascii_lower(F.col("text")), SEPARATORS).alias("words"))
    gram = lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, K)])
    grams = F.when(F.size("words") >= K, F.transform(F.slice("words", 1, F.greatest(F.size("words") - K + 1, F.lit(0))), gram))
    at = at.withColumn("grams", grams).select("doc_id", "row", "words", F.size("words").cast("long").alias("n_words"), F.posexplode_outer("grams").alias("i", "h"))
    # The templates are fixed in the code, so their broadcast does not grow with the data.
    met = at.join(F.broadcast(known), "h", "left")
    real = F.coalesce(F.slice("words", F.col("i") + 1, K) == F.col("gram"), F.lit(False))
    met = met.where(real | F.coalesce(F.col("i") == 0, F.lit(True)))
    return met.select("doc_id", "row", "n_words", "i", *[F.when(real, F.col(c)).alias(c) for c in ("tid", "label", "base", "j", "n_grams")])


def _chain(hits: Column, places: Column) -> Column:
    """Of hits (i, j), the longest chain of rising i and j: how many, first i, last i. State: for each j the best chain that ends there."""
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("first"), F.lit(0).alias("last"))
    ordered = F.array_sort(F.transform(hits, lambda h: F.struct(h["i"].alias("i"), (-h["j"]).alias("back"))))  # of one i the last place first, so none follows another

    def step(best: Column, h: Column) -> Column:
        j = -h["back"]
        before = F.when(j > 0, F.array_max(F.slice(best, 1, F.greatest(j, F.lit(1))))).otherwise(none)
        here = F.struct((before["n"] + 1).alias("n"), F.when(before["n"] > 0, before["first"]).otherwise(h["i"]).alias("first"), h["i"].alias("last"))
        return F.transform(best, lambda x, k: F.when((k == j) & (here["n"] > x["n"]), here).otherwise(x))

    return F.array_max(F.aggregate(ordered, F.transform(F.sequence(F.lit(1), places), lambda _: none), step))


def scan(docs: DataFrame, coverage: float = 0.75, slack: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans, for each row of docs.

    spans: array of (label, base, first, last) by first word, last included. score: the largest share of a template's
    k-grams that one band holds in order, 0 without a hit. Null text has no words. Repeated rows and null doc_ids each
    give their own row; other columns are not looked at. Rows are numbered when hits are stored, before anything is
    shuffled, so a lost task can't number them otherwise.
    """
    known = templates(docs.sparkSession)
    found = stored(hits(docs, known), "hits").withColumn("diagonal", F.col("i") - F.col("j"))
    keys = ["row", "doc_id", "n_words"]
    template = ["tid", "label", "base", "n_grams"]
    lines = found.groupBy(*keys, *template, "diagonal").agg(F.count("*").alias("votes"), F.collect_list(F.when(~F.col("base"), F.struct("i", "j"))).alias("hits"))
    order = Window.partitionBy("row", "tid").orderBy("diagonal")
    new = F.coalesce("base", F.lit(True)) | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order), F.lit(slack + 1)) > slack)
    marked = lines.withColumn("new", new.cast("int")).withColumn("band", F.sum("new").over(order))
    merged = marked.groupBy(*keys, *template, "band").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("at"), F.flatten(F.collect_list("hits")).alias("hits"))
    merged = merged.withColumn("chain", F.when(~F.col("base"), _chain(F.col("hits"), F.col("n_grams"))))
    held = F.when(F.col("base"), F.col("votes")).otherwise(F.col("chain.n"))
    share = F.when(F.col("tid").isNotNull(), held / F.col("n_grams"))
    full = F.coalesce(F.col("base") & (F.col("votes") == F.col("n_grams")), F.lit(False))
    named = full | F.coalesce(~F.col("base") & (share >= coverage), F.lit(False))
    first, last = F.when(F.col("base"), F.col("at")).otherwise(F.col("chain.first")), F.when(F.col("base"), F.col("at") + F.col("n_grams") - 1).otherwise(F.col("chain.last")) + K - 1
    sorted_ = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        merged.groupBy(*keys)
        .agg(
            F.count_if(full).cast("long").alias("n_base"),
            F.min(F.when(full, F.col("at"))).cast("long").alias("first_word"),
            F.max(F.when(full, F.col("at"))).cast("long").alias("last_word"),
            sorted_(F.when(full, F.col("label"))).alias("base_labels"),
            sorted_(F.when(named, F.col("label"))).alias("labels"),
            F.coalesce(F.max(share), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(named, F.struct(first.alias("first"), last.alias("last"), F.col("label"), F.col("base"))))).alias("spans"),
        )
        .drop("row")
    )
