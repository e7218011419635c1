"""License scan by diagonal voting, in DataFrame expressions only.

Phrases and notices are templates, cut into word k-grams like the texts: pairs for phrases, triples for notices. All
rolling k-gram hashes of all texts are joined to the template positions; each match votes for its diagonal, text
position less template position. Diagonals of a template that lie within ``DRIFT`` words of the next are merged, so
inserted or missing words don't split a notice. A span is verified: its longest chain of matches that goes forward in
the text and in the template must cover ``COVERAGE`` of the template's k-grams, and be at most ``STRETCH`` times as
long as the template (and ``DRIFT`` words); a phrase needs all its words on one diagonal. Words are compared by 64-bit
hashes of k-grams.

Templates are a table: a row each with ``template`` (lower-case words, one space between), ``label`` and ``k``. Their
positions are broadcast up to ``BROADCAST_GRAMS`` (counted first), else joined by shuffle. Only matches leave the row
of their text, under a key for the row, so no group is larger than a document's matches and repeated ids don't mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize

#: Phrases whose places are base matches, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Public license notices, and their labels.
NOTICES = {
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software": "mit",
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2.0",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-2.0",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "released under the bsd license": "bsd",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "licensed under the gnu lesser general public license": "lgpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license": "mpl-2.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons": "cc",
}
PAIR, TRIPLE = 2, 3
DRIFT = 4
COVERAGE, STRETCH = 0.6, 1.5
#: A hash that no k-gram is meant to have.
MARK = 0x4D41524B4D41524B
#: Template positions (some 40 bytes each) that may be broadcast.
BROADCAST_GRAMS = 500_000

#: Everything in ASCII that is no digit and no letter.
_OTHER = "".join(map(chr, [*range(0, 48), *range(58, 65), *range(91, 97), *range(123, 128)]))


def words(text: Column) -> Column:
    """Words in lower case: runs of digits, ASCII letters and anything beyond ASCII.

    ``lower`` also changes letters beyond ASCII. That can't make or break a match with an ASCII template but for
    the two letters whose lower case holds ASCII, the Kelvin sign and the dotted capital I; they are replaced first.
    """
    plain = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ı"))
    inner = F.btrim(plain, F.lit(_OTHER))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(F.lower(inner), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(F.lit(len(words)), *words)


def templates(spark: SparkSession) -> DataFrame:
    """The fixed phrases and notices."""
    rows = [(t, label, k) for texts, k in ((PHRASES, PAIR), (NOTICES, TRIPLE)) for t, label in texts.items()]
    return spark.createDataFrame(rows, "template string, label string, k int")


def _positions(table: DataFrame) -> DataFrame:
    """Every k-gram of every template: ``hash`` and ``at`` (template, label, k, position, number of k-grams)."""
    cut = table.withColumn("w", F.split("template", " ")).withColumn("n_grams", F.size("w") - F.col("k") + 1).filter("n_grams > 0")
    each = cut.withColumn("t_pos", F.explode(F.sequence(F.lit(0), F.col("n_grams") - 1)))
    gram = lambda k: _hash([F.get("w", F.col("t_pos") + j) for j in range(k)])
    return each.select(F.when(F.col("k") == PAIR, gram(PAIR)).otherwise(gram(TRIPLE)).alias("hash"), F.struct("template", "label", "k", "n_grams", "t_pos").alias("at"))


def matches(docs: DataFrame, table: DataFrame) -> DataFrame:
    """A key for each row, ``doc_id``, ``n_words`` and ``hits``, the positions of its k-grams with the template positions they match.

    Every row gets a mark before its words, which the table holds too, so that rows without a match stay. Words stand
    beside the next two in one array, so that hashing and joining are compiled into one loop over its elements.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.concat(F.array(F.lit("")), words(F.coalesce(F.col("text"), F.lit("")))).alias("w"))
    n = F.size("w")
    beside = F.arrays_zip(F.col("w"), F.slice("w", 2, n), F.slice("w", 3, n)).cast("array<struct<a:string,b:string,c:string>>")
    each = base.select("row", "doc_id", (n - 1).cast("long").alias("n_words"), F.posexplode(beside).alias("place", "g"))
    a, b, c = (F.col("g").getField(x) for x in ("a", "b", "c"))
    hashes = F.when(F.col("place") == 0, F.array(F.lit(MARK))).otherwise(F.array(_hash([a, b]), _hash([a, b, c])))
    grams = each.select("row", "doc_id", "n_words", (F.col("place") - 1).alias("pos"), F.explode(hashes).alias("hash"))
    known = _positions(table)
    known = known.unionByName(docs.sparkSession.range(1).select(F.lit(MARK).alias("hash"), F.lit(None).cast(known.schema["at"].dataType).alias("at")))
    if known.count() <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    hit = F.when(F.col("at").isNotNull() & (F.col("pos") >= 0), F.struct("pos", "at"))
    return grams.join(known, "hash").groupBy("row", "doc_id", "n_words").agg(F.collect_list(hit).alias("hits"))


def _chain(found: Column) -> Column:
    """Length, first and end position of the longest chain of (pos, t_pos), sorted, that goes forward in both.

    The ends of the best chains by length are kept as an array, each with the place where its chain began.
    """
    place = "struct<t:int,first:int,last:int>"
    empty = F.array().cast(f"array<{place}>")

    def grow(ends: Column, x: Column) -> Column:
        before = F.filter(ends, lambda e: e["t"] < x["t_pos"])
        n = F.size(before)
        fresh = F.struct(x["t_pos"].alias("t"), F.coalesce(F.get(before, n - 1)["first"], x["pos"]).alias("first"), x["pos"].alias("last"))
        return F.concat(before, F.array(fresh).cast(f"array<{place}>"), F.slice(ends, n + 2, F.greatest(F.size(ends) - n - 1, F.lit(0))))

    done = lambda ends: F.struct(F.size(ends).alias("n"), F.get(ends, F.size(ends) - 1)["first"].alias("first"), F.get(ends, F.size(ends) - 1)["last"].alias("last"))
    return F.aggregate(found, empty, grow, done)


def scan_licenses(docs: DataFrame, coverage: float = COVERAGE, table: DataFrame | None = None) -> DataFrame:
    """License phrases and notices of every whole text.

    Returns ``doc_id``, ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (smallest
    and largest start of a place; else null), ``base_labels`` and ``labels`` (distinct, sorted, comma-joined; ""
    if none) and ``score``, the largest share of a template found (1 for a phrase, 0 for nothing). Null and
    empty texts have no words. Repeated rows are scanned each. A text of any length is scanned whole, its words in
    the memory of one task. Of equally long chains the one that ends earliest in the template counts.
    """
    spark = docs.sparkSession
    digest = materialize(matches(docs, table if table is not None else templates(spark)), "license-matches")
    voted = digest.filter(F.size("hits") > 0).select("row", F.explode("hits").alias("g")).select("row", "g.pos", "g.at.*")
    diagonal = F.col("pos") - F.col("t_pos")
    lines = voted.groupBy("row", "template", "label", "k", "n_grams", diagonal.alias("diagonal")).agg(F.collect_list(F.struct("pos", "t_pos")).alias("found"))
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    phrase = F.col("k") == PAIR
    fresh = (phrase | F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > DRIFT, F.lit(True))).cast("int")
    merged = lines.withColumn("group", F.sum(fresh).over(order)).groupBy("row", "template", "label", "k", "n_grams", "group").agg(F.min("diagonal").alias("start"), F.flatten(F.collect_list("found")).alias("found"))
    # In the text's order; of matches at one place the later in the template first, so that a chain takes one of them.
    sorted_ = F.transform(F.array_sort(F.transform("found", lambda x: F.struct(x["pos"].alias("pos"), (-x["t_pos"]).alias("back")))), lambda x: F.struct(x["pos"].alias("pos"), (-x["back"]).alias("t_pos")))
    chained = merged.withColumn("chain", _chain(sorted_)).withColumn("share", F.col("chain.n") / F.col("n_grams"))
    short = F.col("chain.last") - F.col("chain.first") < STRETCH * F.col("n_grams") + DRIFT
    spans = chained.filter(F.when(phrase, F.col("share") == 1).otherwise((F.col("share") >= coverage) & short))
    base = F.when(phrase, F.col("start"))
    result = spans.groupBy("row").agg(
        F.count(base).alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(phrase, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    none = F.lit("")
    return digest.join(result, "row", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
