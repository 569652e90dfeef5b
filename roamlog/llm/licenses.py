"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

A template is its words. Hashes of its runs of ``GRAM`` words are winnowed: of every ``WINNOW`` neighbours the smallest
is kept. The inverted index lists templates and positions under each kept hash. Every run of words of every document is
looked up in it, so a shared stretch of GRAM + WINNOW - 1 words is always seen. A hit puts the template on a diagonal of
the document; hits on diagonals of one bin of ``BAND`` are one candidate, which is aligned word by word inside the band
(local alignment: 2 for a match, -1 for a mismatch or a gap). Coverage is the share of the template's words that match.
A found place is masked and the band aligned again until its best is below the bar, so copies beside each other are all
found. Of overlapping matches of one template the best is reported, and then the best of those that it leaves.

The index is broadcast while it has at most ``BROADCAST_ROWS`` rows, counted beforehand, and joined by shuffle beyond.

Null and empty texts and templates match nothing. Rows that repeat an id are scanned by their own text; equal rows give
equal matches, each once per row.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from roamlog.llm.common import query, table, with_row_key
from roamlog.llm.decontaminate import words_of
from roamlog.session import stage

GRAM, WINNOW, BAND = 3, 4, 8
BROADCAST_ROWS = 100_000
MIN_COVERAGE = 0.7

#: Notices and opening passages of public licenses.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
                'documentation files (the "Software"), to deal in the Software without restriction, including without '
                'limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of '
                'the Software, and to permit persons to whom the Software is furnished to do so',
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
                         'compliance with the License. You may obtain a copy of the License at',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                      "General Public License as published by the Free Software Foundation, either version 3 of the "
                      "License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "license string, text string")


def inverted_index(templates: DataFrame, name: str = "license", text: str = "text") -> DataFrame:
    """(hash, license, position, words): the winnowed runs of words of each template."""
    t = templates.select(F.col(name).alias("license"), words_of(F.col(text)).alias("words")).filter("size(words) > 0")
    size = F.least(F.size("words"), F.lit(GRAM))
    at = F.expr(f"sequence(0, size(words) - least(size(words), {GRAM}))")
    runs = t.select("license", "words", F.explode(at).alias("position")).withColumn("hash", F.when(
        size == 3, F.xxhash64(F.lit(3), *[F.get("words", F.col("position") + k) for k in range(3)])).when(
        size == 2, F.xxhash64(F.lit(2), *[F.get("words", F.col("position") + k) for k in range(2)])).otherwise(
        F.xxhash64(F.lit(1), F.get("words", F.col("position")))))
    # A run is kept if it is the smallest (the last of equals) of some window of neighbours that it is in.
    order = Window.partitionBy("license", "words").orderBy("position")
    last = F.max("position").over(Window.partitionBy("license", "words"))
    rank = F.struct("hash", (-F.col("position")).alias("p"))
    kept = None
    for back in range(WINNOW):
        window = order.rowsBetween(-back, WINNOW - 1 - back)
        whole = (F.col("position") - back >= 0) & (F.col("position") + WINNOW - 1 - back <= last) | (last < WINNOW - 1)
        smallest = whole & (F.min(rank).over(window) == rank)
        kept = smallest if kept is None else kept | smallest
    return runs.withColumn("kept", kept).filter("kept").select("hash", "license", "position", F.col("words").alias("template"))


def align(template: list[str], words: list[str], diagonal: int) -> tuple[int, int, int, int]:
    """Best local alignment near the diagonal: (score, matches, start, end) in ``words``."""
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}  # column -> score, matches, start
    for i, w in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - BAND), min(len(words), i + diagonal + BAND + 1)):
            s, m, start = above.get(j - 1, (0, 0, j))
            here = (s + 2, m + 1, start if s else j) if w == words[j] else (s - 1, m, start)
            for s, m, start in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                if s - 1 > here[0]:
                    here = (s - 1, m, start)
            if here[0] > 0:
                row[j] = here
                if here[0] > best[0]:
                    best = (*here, j + 1)
        above = row
    return best


def alignments(template: list[str], words: list[str], diagonal: int, min_coverage: float) -> list[tuple[int, int, int, int]]:
    """Every alignment of ``align`` near the diagonal that covers enough, best first, none over words of another."""
    left, found = list(words), []
    while (best := align(template, left, diagonal))[1] and best[1] / len(template) >= min_coverage:
        found.append(best)
        left[best[2] : best[3]] = [None] * (best[3] - best[2])
    return found


def apart(matches: list[dict]) -> list[dict]:
    """The matches of one template in one row that stay: the best, then the best that overlaps none of them, and so on."""
    starts, chosen = [], []
    for m in sorted(matches, key=lambda m: (-m["score"], m["start_word"], m["end_word"])):
        k = bisect.bisect_left(starts, m["start_word"])
        if (k == 0 or chosen[k - 1]["end_word"] <= m["start_word"]) and (k == len(starts) or m["end_word"] <= starts[k]):
            starts.insert(k, m["start_word"])
            chosen.insert(k, m)
    return chosen


def scan(docs: DataFrame, templates: DataFrame, min_coverage: float = MIN_COVERAGE, id_col: str = "doc_id", text: str = "text",
         name: str = "license", template: str = "text") -> DataFrame:
    """Per match: ``id_col``, license, coverage, matched words, and its span in words and as text."""
    index = stage(inverted_index(templates, name, template), "license-index")
    small = F.broadcast if index.count() <= BROADCAST_ROWS else (lambda df: df)
    longest = index.agg(F.max(F.size("template"))).head()[0] or 0
    sizes = sorted({min(GRAM, r[0]) for r in index.select(F.size("template")).distinct().collect()}) or [GRAM]
    rows = with_row_key(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "id", "text").withColumn(
        "_row", F.monotonically_increasing_id())
    each = rows.select("_row", "id", words_of(F.col("text")).alias("words")).select(
        "_row", "id", "words", F.posexplode_outer("words").alias("at", "_w"))
    keys = [F.xxhash64(F.lit(s), *[F.get("words", F.col("at") + k) for k in range(s)]) for s in sizes]
    each = each.withColumn("hash", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))
    # A candidate: the bin of the diagonal, with the words the template can reach from it.
    bin_ = F.floor((F.col("at") - F.col("position")) / BAND).cast("int")
    first = F.greatest(bin_ * BAND - BAND, F.lit(0)).cast("int")
    hits = each.join(small(index), "hash").select(
        "_row", "id", "license", "template", bin_.alias("bin"), first.alias("first"),
        F.slice("words", first + 1, F.lit(int(longest) + 3 * BAND)).alias("near"))
    chosen = stage(hits.groupBy("_row", "license", "template", "bin").agg(
        F.first("id").alias("id"), F.first("first").alias("first"), F.first("near").alias("near"), F.count("*").alias("hits")), "license-candidates")
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, source = [], []
            for n, (t, near, k, f) in enumerate(zip(*(b.column(c).to_pylist() for c in ("template", "near", "bin", "first")))):
                for score, m, start, end in alignments(t, near, k * BAND - f + BAND // 2, min_coverage):
                    found.append((score, m, m / len(t), f + start, f + end, " ".join(near[start:end])))
                    source.append(n)
            columns = list(zip(*found)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c).take(pa.array(source, pa.int64())) for c in ("_row", "id", "license")] + [pa.array(v, kind) for v, kind in zip(columns, kinds)],
                names=["_row", "id", "license", "score", "n_matched", "coverage", "start_word", "end_word", "matched"])

    aligned = chosen.select("_row", "id", "license", "template", "bin", "first", "near").mapInArrow(
        run, f"_row long, id {id_type}, license string, score long, n_matched long, coverage double, start_word long, end_word long, matched string")
    # Neighbouring bins find the same place: of overlapping matches the best stays.
    names = ["score", "n_matched", "coverage", "start_word", "end_word", "matched"]
    each = aligned.dropDuplicates(["_row", "license", "start_word", "end_word"]).groupBy("_row", "license").agg(
        F.first("id").alias("id"), F.collect_list(F.struct(*names)).alias("matches"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field("matches").type
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("license"), pa.array([apart(m) for m in b.column("matches").to_pylist()], kind)],
                                             names=["id", "license", "matches"])

    kind = each.schema["matches"].dataType.simpleString()
    good = each.mapInArrow(choose, f"id {id_type}, license string, matches {kind}").select("id", "license", F.explode("matches").alias("m"))
    return good.select(F.col("id").alias(id_col), "license", F.round("m.coverage", 9).alias("coverage"), "m.n_matched", "m.start_word",
                       "m.end_word", "m.matched")


@query("op6_license_scan")
def _(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"), default_templates(spark))
