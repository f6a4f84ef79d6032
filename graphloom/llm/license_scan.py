"""License scans by diagonal voting (DataFrame operations only).

All rolling word k-grams of the documents are hashed and joined with the positions that the grams have in a fixed table of
license templates. A hit at document word ``p`` and template word ``t`` votes for the diagonal ``p - t``. Votes are summed
per (document, template, diagonal), neighbouring diagonals are merged, which bridges inserted or missing words, and the
merged spans are verified: hits against the words themselves, and spans by how many different places of the template they
hit, so that a part which is said twice counts once. Short phrases use pairs of words and need every pair of their diagonal;
notices use fours and need most of them.

The template table is a constant of this module (about a thousand grams), so it is broadcast; grams that no template has
never leave the scan. A sentinel gram gives each document one row, so that one pass also carries the word counts.

Defined cases: a null or empty text has no words, no places and the empty labels; rows that repeat (doc_id, text) each get
their row; a null doc_id is kept; overlapping templates all vote; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import ascii_lower, let, text_of

#: What separates words, and the phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices that licenses ask to be put on works, by label.
NOTICES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ),
    "gpl-3.0": ("licensed under the gnu general public license version 3",),
    "gpl-2.0": ("licensed under the gnu general public license version 2",),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation",),
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation",),
    "mit-notice": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "licensed under the mit license",
        "released under the mit license",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0",),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0",),
    "cc-by-4.0": ("licensed under cc by 4 0",),
    "creative-commons": ("this work is licensed under a creative commons attribution",),
}
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Diagonals at most so far apart are merged; a merged span needs this share of the template's grams, and all of them in
#: templates of few grams, which may differ in a version number alone.
NEIGHBOURS, LEAST_SHARE, FEW_GRAMS = 4, 0.6, 10


def templates() -> list[tuple[int, str, bool, list[str], int]]:
    """(id, label, whether a base phrase, words, k)."""
    base = [(label, True, phrase) for phrase, label in PHRASES.items()]
    more = [(label, False, text) for label, texts in NOTICES.items() for text in texts]
    if any(len(text.split()) > 63 for _, _, text in base + more):
        raise ValueError("a template has at most 63 words: its places are the bits of a number")
    return [(i, label, is_base, text.split(), PHRASE_GRAM if is_base else NOTICE_GRAM) for i, (label, is_base, text) in enumerate(base + more)]


def _pairs(items: Column, step: int) -> Column:
    return F.zip_with(items, F.slice(items, F.lit(step + 1), F.size(items)), lambda a, b: F.xxhash64(a, b))


def _grams(words: Column, body) -> Column:
    """``body`` of the hashes of pairs and of fours that start at each word; each is computed once."""
    return let(_pairs(words, 1), lambda two: let(_pairs(two, 2), lambda four: body(two, four)))


def template_grams(spark: SparkSession) -> DataFrame:
    """A row for each gram of each template, and the sentinel that each document hits once."""
    schema = T.StructType([T.StructField("__tid", T.IntegerType()), T.StructField("__words", T.ArrayType(T.StringType())), T.StructField("__k", T.IntegerType())])
    rows = spark.createDataFrame([(i, words, k) for i, _, _, words, k in templates()], schema)
    rows = rows.withColumn("__g", _grams(F.col("__words"), lambda two, four: F.when(F.col("__k") == PHRASE_GRAM, two).otherwise(four)))
    rows = rows.withColumn("__g", F.slice("__g", F.lit(1), F.size("__words") - F.col("__k") + 1))
    rows = rows.select("__tid", "__k", "__words", F.posexplode("__g").alias("__t", "__gram"))
    rows = rows.select("__gram", "__tid", "__k", "__t", F.slice("__words", F.col("__t") + 1, F.col("__k")).alias("__has"))
    return rows.unionByName(spark.range(1).select(F.lit(0).cast("long").alias("__gram"), F.lit(-1).alias("__tid"), F.lit(0).alias("__k"), F.lit(0).alias("__t"), F.lit(None).cast("array<string>").alias("__has")))


def _votes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Gram hits per (document, template, diagonal), and the template's places they hit, a bit each; template -1 counts the
    document's rows."""
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__row"), F.array_remove(F.split(ascii_lower(text), SEPARATORS), "").alias("__w"))
    grams = _grams(F.col("__w"), lambda two, four: F.concat(F.array(F.lit(0).cast("long")), two, four))
    rows = rows.select("__id", "__row", "__w", F.size("__w").alias("__n"), grams.alias("__grams"))
    # The arrays are never empty; the outer form keeps the optimizer from computing them twice to test for that.
    hits = rows.select("__id", "__row", "__n", "__w", F.posexplode_outer("__grams").alias("__p", "__gram")).join(F.broadcast(template_grams(docs.sparkSession)), "__gram")
    hits = hits.withColumn("__p", F.when(F.col("__p") > F.col("__n"), F.col("__p") - F.col("__n")).otherwise(F.col("__p")) - 1)
    hits = hits.where((F.col("__tid") < 0) | (F.slice("__w", F.greatest(F.col("__p"), F.lit(0)) + 1, F.col("__k")) == F.col("__has")))
    return hits.groupBy("__id", "__row", "__n", "__tid", (F.col("__p") - F.col("__t")).alias("__d")).agg(F.count("*").alias("__v"), F.bit_or(F.expr("shiftleft(1L, __t)")).alias("__hit"), F.min("__p").alias("__lo"), F.max(F.col("__p") + F.col("__k")).alias("__hi"))


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per (document, template, merged diagonals): first and last word, and how many of the template's grams they hit and
    it has.

    Rows of template -1 stand for the documents themselves; ``__v`` is how many rows share (id, text).
    """
    known = templates()
    needed = F.create_map(*[F.lit(x) for i, _, _, words, k in known for x in (i, len(words) - k + 1)])
    by = Window.partitionBy("__id", "__row", "__tid").orderBy("__d")
    votes = _votes(docs, id_col, text_col)
    base = F.col("__tid").isin([i for i, _, is_base, _, _ in known if is_base])
    apart = F.when(base, F.lit(1)).otherwise((F.col("__d") - F.lag("__d").over(by) > NEIGHBOURS).cast("int"))
    run = F.sum(F.coalesce(F.col("__new"), F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    spans = votes.withColumn("__new", apart).withColumn("__run", run).groupBy("__id", "__row", "__n", "__tid", "__run").agg(F.sum("__v").alias("__v"), F.bit_count(F.bit_or("__hit")).alias("__hit"), F.min("__d").alias("__d"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    return spans.withColumn("__need", needed[F.col("__tid")])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans`` lists the verified places as (label, start, end, share), words from 0, end exclusive.
    """
    known = templates()
    label = F.create_map(*[F.lit(x) for i, name, _, _, _ in known for x in (i, name)])
    n_base = sum(is_base for _, _, is_base, _, _ in known)
    spans = license_spans(docs, id_col, text_col)
    doc = ["__id", "__row"]
    # Equal rows vote together; their number is the sentinel's votes.
    whole = spans.groupBy(*doc).agg(
        F.max("__n").alias("__n"),
        F.max(F.when(F.col("__tid") < 0, F.col("__v"))).alias("__copies"),
        F.collect_list(F.when(F.col("__tid") >= 0, F.struct("__lo", "__hi", "__tid", "__d", "__hit", "__need"))).alias("__s"),
    )
    share = lambda s: s["__hit"] / s["__need"]
    base = F.filter("__s", lambda s: (s["__tid"] < n_base) & (s["__hit"] == s["__need"]))
    more = F.filter("__s", lambda s: (s["__tid"] >= n_base) & (share(s) >= F.when(s["__need"] <= FEW_GRAMS, F.lit(1.0)).otherwise(F.lit(LEAST_SHARE))))
    found = whole.withColumns({"__base": base, "__more": more})
    found = found.withColumn("__all", F.array_sort(F.transform(F.concat("__base", "__more"), lambda s: F.struct(s["__lo"].cast("long").alias("start"), s["__hi"].cast("long").alias("end"), label[s["__tid"]].alias("label"), share(s).alias("share")))))
    joined = lambda column, field: F.array_join(F.array_sort(F.array_distinct(F.transform(column, field))), ",")
    out = found.select(
        F.col("__id").alias(id_col),
        F.col("__n").cast("long").alias("n_words"),
        F.size("__base").cast("long").alias("n_base"),
        F.array_min(F.transform("__base", lambda s: s["__d"])).cast("long").alias("first_word"),
        F.array_max(F.transform("__base", lambda s: s["__d"])).cast("long").alias("last_word"),
        joined("__base", lambda s: label[s["__tid"]]).alias("base_labels"),
        joined("__all", lambda s: s["label"]).alias("labels"),
        F.coalesce(F.array_max(F.transform("__all", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.col("__all").alias("spans"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__i"),
    )
    return out.drop("__i")
