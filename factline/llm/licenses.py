"""License scans by diagonal voting (DataFrame functions only).

All rolling word 3-grams of a text are joined, by hash and then by words, to the positions of the license templates.
Each match votes for a diagonal (document position minus template position). A span is a diagonal of one template
merged with those up to the template's slack further, never more; it is verified by the share of the template's 3-gram
positions that it holds, each counted once, so that a repeated phrase votes once. Of spans within the slack of one
another the best is kept.

Edge cases: null and empty texts give no words, no labels and score 0; every input row gives one output row, repeated
rows and doc_ids too; texts shorter than three words have no 3-gram; further columns are ignored; an empty table
gives an empty result. A place counts once for each template; overlapping places of different templates all count.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.llm.text import alnum_words

K = 3
MOST_TEMPLATE_WORDS = 50_000  # the broadcast side is a parameter of this size at most


@dataclass(frozen=True)
class Template:
    """text: words; base: counted exactly; slack: words that may be added or missing; share: of 3-grams to hold."""

    label: str
    text: str
    base: bool = False
    slack: int = 0
    share: float = 1.0


BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
#: Openings of well-known licenses and their usual notices.
FURTHER = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", slack=4, share=0.8),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", slack=3, share=0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", slack=3, share=0.8),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", slack=3, share=0.8),
    Template("lgpl", "gnu lesser general public license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", slack=3, share=0.8),
    Template("unlicense", "this is free and unencumbered software released into the public domain", slack=2, share=0.8),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("all-rights-reserved", "all rights reserved"),
)


def positions(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """One row per 3-gram of each template; and the row with the empty gram, which every document has once."""
    rows: list[tuple] = [("", -1, 0, 1, "", False, 0, 1.0)]
    for t, template in enumerate(templates):
        words = template.text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {template.text}")
        n = len(words) - K + 1
        rows += [(" ".join(words[i : i + K]), t, i, n, template.label, template.base, template.slack, template.share) for i in range(n)]
    if len(rows) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATE_WORDS} template words")
    df = spark.createDataFrame(rows, "t_gram string, template int, t_at int, n_grams int, label string, base boolean, slack int, share double")
    return df.withColumn("t_hash", F.xxhash64("t_gram"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + FURTHER) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    rows = docs.select("doc_id", alnum_words(F.col("text")).alias("w")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "w", F.size("w").alias("n_words"))
    grams = F.transform(F.sequence(F.lit(0), F.col("n_words") - K), lambda i: F.concat_ws(" ", *[F.get("w", i + j) for j in range(K)]))
    all_grams = F.when(F.col("n_words") >= K, F.concat(grams, F.array(F.lit("")))).otherwise(F.array(F.lit("")))
    exploded = rows.select("row", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.posexplode(all_grams).alias("at", "gram")).withColumn("hash", F.xxhash64("gram"))
    known = F.broadcast(positions(docs.sparkSession, templates))  # bounded by MOST_TEMPLATE_WORDS
    votes = exploded.join(known, (F.col("hash") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram")))
    key = ["row", "doc_id", "n_words", "template", "n_grams", "label", "base", "slack", "share"]
    at_diagonal = F.col("at") - F.when(F.col("template") < 0, F.col("at")).otherwise(F.col("t_at"))
    diagonals = votes.groupBy(*key, at_diagonal.cast("long").alias("diagonal")).agg(F.collect_list(F.when(F.col("template") >= 0, F.col("t_at"))).alias("places"))
    # the span of a diagonal: the distinct template positions on it and on those up to `slack` words further
    most = max((t.slack for t in templates), default=0)
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    near = lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("slack")
    ahead = F.collect_list(F.struct("diagonal", "places")).over(by.rangeBetween(0, most))
    held = F.size(F.array_distinct(F.flatten(F.transform(F.filter(ahead, near), lambda x: x["places"]))))
    spans = diagonals.withColumn("score", held / F.col("n_grams"))
    # of spans whose diagonals lie within `slack`, the best stands for all, the first of equal ones
    around = F.collect_list(F.struct("diagonal", "score")).over(by.rangeBetween(-most, most))
    better = lambda x: (x["score"] > F.col("score")) | ((x["score"] == F.col("score")) & (x["diagonal"] < F.col("diagonal")))
    spans = spans.withColumn("beaten", F.exists(around, lambda x: near(x) & better(x))).withColumn("first", F.col("diagonal"))
    spans = spans.withColumn("found", (F.col("template") >= 0) & (F.col("score") >= F.col("share")) & ~F.col("beaten"))
    is_base = F.col("found") & F.col("base")
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(is_base).alias("n_base"),
        F.min(F.when(is_base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("found"), F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(F.col("template") >= 0, F.col("score"))), F.lit(0.0)).alias("score"),
        F.count_if("found").alias("n_spans"),
    )
    return out.drop("row")
