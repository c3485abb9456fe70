"""Operator 11: license scans by diagonal voting.

Every rolling k-gram of words of every text is hashed (numpy, in Arrow batches) and joined in Spark to
the positions of the templates' k-grams. A hit at word i of a text and word j of a template votes for
the diagonal i - j; votes are counted by text, template and diagonal, and diagonals at most ``DRIFT``
words apart (a few words put in or left out) are merged to one candidate span. Candidates go back to
their texts, where the template's words are compared with the text's own words along the voted
diagonals: the share of the template inside equal runs of k words or more decides.

The templates' grams are a parameter of counted size: they are broadcast up to ``MAX_GRAMS``, so the
texts' grams are looked up where they are made and only hits are shuffled; beyond that the join shuffles.
Texts are named by their MD5, so copies vote together, combined before the shuffle, and no row number has
to be the same in two passes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.llm.common import ALNUM_TABLE, bound_batches, byte_values, give_back, split_batch, stage_table

# Phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Label and wording of public license notices.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)

K = 4
#: Neighbouring diagonals at most so many words apart are one span.
DRIFT = 6
#: Least share of a template's words that a span has to hold.
COVER = 0.7
#: Score of a text with a phrase but no verified span.
PHRASE_SCORE = 0.5
#: Template grams, and span bytes, that are broadcast at most.
MAX_GRAMS = 200_000
MAX_SPAN_BYTES = 16_000_000
#: Grams in a row, so that a very long text is several rows.
ROW_GRAMS = 1 << 16
_BASE = np.uint64(0x9E3779B97F4A7C15)

ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_SPANS = T.ArrayType(T.StructType([T.StructField("template", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("cover", T.DoubleType())]))


def words_of(data: bytes) -> list[bytes]:
    """Lower-case words: runs of digits, letters and bytes above ASCII."""
    return data.translate(ALNUM_TABLE).split()


def gram_hashes(words: list[bytes], k: int, known: dict[bytes, int]) -> np.ndarray:
    """The hash of each run of k words; ``known`` keeps the hashes of words."""
    if len(words) < k:
        return np.zeros(0, np.int64)
    codes = np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        code = known.get(w)
        if code is None:
            code = known[w] = xxhash.xxh3_64_intdigest(w)
        codes[i] = code
    n = len(words) - k + 1
    total = np.ones(n, np.uint64)
    for j in range(k):
        total = (total ^ (total >> np.uint64(32))) * _BASE + codes[j : j + n]
    return total.view(np.int64)


def scan_documents(df: DataFrame, templates=TEMPLATES, phrases=PHRASES, text: str = "text", k: int = K, cover: float = COVER) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and spans to every document.

    ``n_base`` counts the places of all phrases, overlapping ones too; ``first_word`` and ``last_word`` are
    the least and greatest of their first words (null without any). ``labels`` are those of the phrases and of
    the verified spans. ``spans`` has template (number in ``templates``), start and end word and the share of
    the template that is covered; ``score`` is the largest share, and at least ``PHRASE_SCORE`` with a phrase.
    Spans of one template whose diagonals are ``DRIFT`` words apart or less are one. Null texts count as empty;
    every row is kept, equal ones too; columns of ``df`` named like the new ones are replaced. Templates of
    fewer than ``k`` words raise.
    """
    bound_batches(df.sparkSession)
    df = df.drop(*ADDED)
    patterns = [words_of(t.encode()) for _, t in templates]
    if any(len(p) < k for p in patterns):
        raise ValueError(f"templates have at least {k} words")
    found = candidates(df, patterns, text, k, cover)
    joined = df.withColumn("__key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).join(found.withColumnRenamed("key", "__found"), F.col("__key") == F.col("__found"), "left").drop("__key", "__found")
    labels = [label for label, _ in templates]
    kept = df.columns
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.DoubleType(), _SPANS)
    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, t) for c, t in zip(ADDED, kinds, strict=True))])
    needles = [(b" " + b" ".join(words_of(p.encode())) + b" ", label) for p, label in phrases]

    def judge(batches):
        for whole in batches:
            for batch in split_batch(whole, text):
                rows = []
                for data, spans in zip(byte_values(batch.column(text)), batch.column("__spans").to_pylist(), strict=True):
                    words = words_of(data)
                    places, base = phrase_places(words, needles)
                    checked = verify_spans(words, patterns, spans, k, cover) if spans else []
                    score = max([x["cover"] for x in checked] + [PHRASE_SCORE if places else 0.0])
                    more = base | {labels[x["template"]] for x in checked}
                    rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(more)), score, checked))
                new = [pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *ADDED])

    return joined.mapInArrow(lambda b: give_back(judge(b)), schema)


_ARROW = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("template", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())])))


def candidates(df: DataFrame, patterns: list[list[bytes]], text: str = "text", k: int = K, cover: float = COVER) -> DataFrame:
    """(key, __spans): for each text with candidates its MD5 and their templates and merged diagonals."""
    spark = df.sparkSession
    known: dict[bytes, int] = {}
    grams = [(h, t, j, len(p)) for t, p in enumerate(patterns) for j, h in enumerate(gram_hashes(p, k, known).tolist())]
    places = spark.createDataFrame(grams, "gram long, template int, j int, size int")
    places = F.broadcast(places) if len(grams) <= MAX_GRAMS else places
    hashed = df.select(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")

    def roll(batches):
        for whole in batches:
            for batch in split_batch(whole, "text"):
                seen: dict[bytes, int] = {}
                keys, starts, lists = [], [], []
                for key, data in zip(batch.column("key").to_pylist(), byte_values(batch.column("text")), strict=True):
                    found = gram_hashes(words_of(data), k, seen)
                    for a in range(0, len(found), ROW_GRAMS):
                        keys.append(key)
                        starts.append(a)
                        lists.append(found[a : a + ROW_GRAMS])
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                values = pa.array(np.concatenate(lists) if lists else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["key", "start", "grams"])

    rolled = hashed.mapInArrow(lambda b: give_back(roll(b)), "key string, start long, grams array<long>")
    hits = rolled.select("key", "start", F.posexplode("grams").alias("at", "gram")).join(places, "gram")
    hits = hits.select("key", "template", "size", (F.col("start") + F.col("at")).alias("i"), (F.col("start") + F.col("at") - F.col("j")).alias("diagonal"))
    # A place counts once, however many copies of the text there are.
    votes = hits.groupBy("key", "template", "size", "diagonal").agg(F.count_distinct("i").alias("votes"))
    apart = Window.partitionBy("key", "template").orderBy("diagonal")
    fresh = (F.col("diagonal") - F.lag("diagonal").over(apart) > DRIFT).cast("int")
    merged = votes.withColumn("__fresh", F.coalesce(fresh, F.lit(0))).withColumn("span", F.sum("__fresh").over(apart))
    spans = merged.groupBy("key", "template", "size", "span").agg(F.sum("votes").alias("votes"), F.sort_array(F.collect_list("diagonal")).alias("diagonals"))
    # Votes of k words each can't cover more.
    spans = spans.where(F.col("votes") * k >= F.lit(cover) * F.col("size"))
    found = stage_table(spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("template", "diagonals"))).alias("__spans")), "license-candidates")
    size = found.agg(F.sum(64 + F.aggregate("__spans", F.lit(0), lambda n, x: n + 16 + 8 * F.size(x["diagonals"]))).alias("n")).first()["n"] or 0
    return F.broadcast(found) if size <= MAX_SPAN_BYTES else found


def phrase_places(words: list[bytes], needles: list[tuple[bytes, str]]) -> tuple[list[int], set[str]]:
    """First words of all places of the phrases, and the labels of those that occur."""
    line = b" " + b" ".join(words) + b" "
    places, labels = [], set()
    for needle, label in needles:
        at, word, last = line.find(needle), 0, 0
        while at >= 0:
            word, last = word + line.count(b" ", last, at), at
            places.append(word)
            labels.add(label)
            at = line.find(needle, at + 1)
    return places, labels


def verify_spans(words: list[bytes], patterns: list[list[bytes]], spans: list[dict], k: int = K, cover: float = COVER) -> list[dict]:
    """Candidates whose template stands in equal runs of k words or more, on the voted diagonals, to the share ``cover``."""
    out = []
    for span in spans:
        pattern = patterns[span["template"]]
        held, start, end = np.zeros(len(pattern), bool), len(words), 0
        for d in span["diagonals"]:
            low, high = max(0, -d), min(len(pattern), len(words) - d)
            same = np.array([0, *(words[j + d] == pattern[j] for j in range(low, high)), 0], np.int8)
            edges = np.diff(same)
            for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True):
                if b - a >= k:
                    held[low + a : low + b] = True
                    start, end = min(start, low + a + d), max(end, low + b + d)
        share = float(held.mean())
        if share >= cover:
            out.append({"template": span["template"], "start": start, "end": end, "cover": share})
    return out
