"""License scans as an exact set-similarity join, in DataFrame operations only.

A block (one line, two neighbouring lines, or a window of words, for notices wrapped over more lines) matches a template if it
holds at least THRESHOLD of the template's distinct words. A window is three times as long as the template it is made for, one
begins at every template length, and it is compared with templates of that length: so twice a template's length in a row,
however it is broken into lines, always stands in a block of its own. A line or two of more words than a template's window are
not compared with that template, so that words scattered over a long line count no more than over many lines. Tokens are ordered by how few documents of the corpus hold them. In that order a block and a
template that match share a token among the first few of both (prefix filter), and what can still follow behind that token
must suffice (positional filter); blocks with too few template words are left out at once (length filter). Pairs that pass
are verified. Places of four fixed phrases are found beside, by their words.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import let, numbered
from stayline.sources.tables import materialize

THRESHOLD = 0.9
#: Length of a window in template lengths.
WINDOW = 3
#: Phrase and label.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Label and the opening or usual form of a public licence notice.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)

LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Words of a template of `size` distinct words that a block must hold."""
    return math.ceil(threshold * size - 1e-9)


def _count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{LETTER}+")).cast("long")


def base_places(text: Column, phrases=PHRASES) -> Column:
    """Struct of n_base, first_word, last_word and base_labels: the texts before, between and behind a phrase's places are counted in words."""
    loose = {phrase: GAP.join(phrase.split()) for phrase, _ in phrases}
    any_phrase = "(?i)" + "|".join(loose.values())
    found = []

    def places(size: int, label: str):
        return lambda parts: F.struct(
            (F.size(parts) - 1).cast("long").alias("n"),
            _count(parts[0]).alias("first"),
            (_count(text) - _count(F.element_at(parts, -1)) - size).alias("last"),
            F.lit(label).alias("label"),
        )

    for phrase, label in phrases:
        exact = f"(?i)(?<!{LETTER}){loose[phrase]}(?!{LETTER})"
        size = len(phrase.split())

        found.append(F.when(text.rlike(exact), let(F.split(text, exact), places(size, label))))
    hits = F.filter(F.array(*found), lambda h: h.isNotNull())

    def summary(h: Column) -> Column:
        return F.struct(
            F.aggregate(h, F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("n_base"),
            F.array_min(F.transform(h, lambda x: x["first"])).alias("first_word"),
            F.array_max(F.transform(h, lambda x: x["last"])).alias("last_word"),
            F.array_sort(F.array_distinct(F.transform(h, lambda x: x["label"]))).alias("base_labels"),
        )

    none = F.struct(
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.array().cast("array<string>").alias("base_labels"),
    )
    return F.when(text.rlike(any_phrase), let(hits, summary)).otherwise(none)


def template_table(templates) -> list[dict]:
    """Number, label, length, distinct words and words needed of each template."""
    out = []
    for number, (label, text) in enumerate(templates):
        every = re.findall(r"[0-9a-z]+", text.lower())
        words = sorted(set(every))
        out.append({"template": number, "label": label, "length": len(every), "words": words, "need": needed(len(words))})
    return out


def _words(text: Column) -> Column:
    """Words with A-Z in lower case. Two letters whose small form begins with an ASCII one are put aside first."""
    text = F.replace(F.replace(text, F.lit("K"), F.lit("ĸ")), F.lit("İ"), F.lit("ĸ"))
    return F.array_remove(F.split(F.lower(text), GAP), "")


def scanned(docs: DataFrame, table: list[dict], id_column: str, text_column: str) -> DataFrame:
    """One numbered row a document: base places, the template words it holds, and the blocks that may match.

    A block is kept if it has as many template words as the least demanding template; a document that holds too few words
    of every template has none. Each block stands with the least and greatest length of the templates that it is compared with.
    """
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for t in table for w in t["words"]})])
    wanted = F.array(*[F.struct(F.array(*[F.lit(w) for w in t["words"]]).alias("words"), F.lit(t["need"]).alias("need")) for t in table])
    least, longest = min(t["need"] for t in table), max(t["length"] for t in table)
    text = F.coalesce(F.col("text"), F.lit(""))

    def possible(held: Column, wanted: Column = wanted) -> Column:
        return F.exists(wanted, lambda t: F.size(F.array_intersect(held, t["words"])) >= t["need"])

    def kept(sets: Column, least: int) -> Column:
        return F.array_distinct(F.filter(sets, lambda block: F.size(block["words"]) >= least))

    def block(words: Column, low: Column, high: int, wanted: Column) -> Column:
        return F.struct(low.cast("int").alias("low"), F.lit(high).alias("high"), F.array_intersect(words, wanted).alias("words"))

    def pairs(lines: Column) -> Column:
        return F.concat(lines, F.transform(lines, lambda line, i: F.concat_ws(" ", line, F.get(lines, i + 1))))

    def blocks(lines: Column) -> Column:
        def whole(words: Column) -> Column:
            return block(words, F.ceil(F.size(words) / WINDOW), longest, vocabulary)

        return kept(F.transform(pairs(lines), lambda line: let(_words(line), whole)), least)

    def cut(words: Column, length: int, wanted: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words), F.lit(length))
        return F.transform(starts, lambda at: block(F.slice(words, at, F.lit(WINDOW * length)), F.lit(length), length, wanted))

    def windows(words: Column) -> Column:
        """Of each template length, if the document holds enough words of a template of that length."""
        found = []
        for length in sorted({t["length"] for t in table}):
            own = [t for t in table if t["length"] == length]
            all_words = F.array(*[F.lit(w) for w in sorted({w for t in own for w in t["words"]})])
            these = F.array(*[F.struct(F.array(*[F.lit(w) for w in t["words"]]).alias("words"), F.lit(t["need"]).alias("need")) for t in own])
            sets = cut(words, length, all_words)
            found.append(F.when(possible(F.col("held"), these), kept(sets, min(t["need"] for t in own))).otherwise(none))
        return F.concat(*found)

    none = F.array().cast("array<struct<low:int,high:int,words:array<string>>>")
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.select(
        "id",
        "text",
        _count(text).alias("n_words"),
        base_places(text).alias("base"),
        F.array_intersect(_words(text), vocabulary).alias("held"),
    )
    # Two lines or fewer, no longer than the shortest template's window, are one block already.
    many = text.rlike("\n[^\n]*\n") | (F.col("n_words") > WINDOW * min(t["length"] for t in table))
    wrapped = F.when(many, let(_words(text), windows)).otherwise(none)
    found = F.when(possible(F.col("held")), F.concat(let(F.split(text, "\n"), blocks), wrapped)).otherwise(none)
    return numbered(rows.select("id", "n_words", "base.*", "held", found.alias("blocks")))


def matches(rows: DataFrame, table: list[dict]) -> DataFrame:
    """(row, label, containment) of every block and template that match."""
    spark = rows.sparkSession
    held = rows.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = {r["word"]: r["n"] for r in held.collect()}
    order = sorted({w for t in table for w in t["words"]}, key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    least = min(t["need"] for t in table)
    prefixes = []
    for t in table:
        ordered = sorted(t["words"], key=rank.get)
        for place, word in enumerate(ordered[: len(ordered) - t["need"] + 1]):
            prefixes.append((word, t["template"], t["label"], t["length"], place, t["words"], t["need"]))
    # At most the words of the templates, which are a parameter.
    theirs = spark.createDataFrame(prefixes, "word string, template int, label string, their_length int, their_place int, words array<string>, need int")
    ranks = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])
    sized = rows.select("row", F.explode("blocks").alias("found")).select("row", "found.low", "found.high", F.col("found.words").alias("block"))
    in_order = F.transform(F.array_sort(F.transform("block", lambda w: F.struct(F.element_at(ranks, w).alias("rank"), w.alias("word")))), lambda s: s["word"])
    sized = sized.select("row", "low", "high", in_order.alias("block"), F.size("block").alias("size"))
    prefix = F.slice("block", F.lit(1), F.col("size") - least + 1)
    ours = sized.select("row", "low", "high", "block", "size", F.posexplode(prefix).alias("place", "word"))
    after = F.least(F.size("words") - F.col("their_place"), F.col("size") - F.col("place"))
    pairs = ours.join(F.broadcast(theirs), "word").filter(F.col("their_length").between(F.col("low"), F.col("high")))
    pairs = pairs.filter((F.col("size") >= F.col("need")) & (F.col("place") <= F.col("size") - F.col("need")) & (after >= F.col("need")))
    shared = F.size(F.array_intersect("block", "words"))
    verified = pairs.withColumn("shared", shared).filter("shared >= need")
    return verified.select("row", "label", (F.col("shared") / F.size("words")).alias("containment"))


def find_licenses(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates=TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is the largest containment of a template that a block of the text meets, 1 if a phrase stands in it, else 0. Null and
    empty texts have no words and no labels. Repeated rows are judged each for itself; an empty table gives no rows.
    """
    table = template_table(templates)
    rows = scanned(docs, table, id_column, text_column)
    found = matches(rows, table).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_column),
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        score.alias("score"),
    )
