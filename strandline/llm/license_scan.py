"""License scan by diagonal voting.

Every rolling pair of words of a text is joined with the places where that pair stands in a
template. A hit votes for the diagonal (place in the text minus place in the template); votes are
summed by diagonal and neighbouring diagonals of one template are merged. Every merged span is then
verified: its words are compared with the template in the order of both, each place of the template
counts once, and the parts of the span that reach the share asked for are its findings. The words of
each hit are compared themselves, so no hash collision becomes a vote.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.llm.common import ROW, map_arrow
from strandline.session import settled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Base phrases: all words must stand consecutively.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further templates and labels; a span needs SHARE of their pairs.
MORE = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "is licensed under the gnu general public license version 3": "gpl-3.0",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "this work is licensed under a creative commons attribution license": "cc-by",
    "mozilla public license version 2 0": "mpl-2.0",
}
SHARE = 0.8
#: Diagonals so far apart still belong to one span (words put in or left out).
GAP = 2


def template_pairs(spark: SparkSession) -> DataFrame:
    """(template, label, base, at, pair, pairs): a few rows a template, whatever the input."""
    rows = []
    for i, (text, label, base) in enumerate([(t, x, True) for t, x in BASE.items()] + [(t, x, False) for t, x in MORE.items()]):
        words = text.split()
        rows += [(i, label, base, j, f"{a} {b}", len(words) - 1) for j, (a, b) in enumerate(zip(words, words[1:]))]
    return spark.createDataFrame(rows, "template int, label string, base boolean, tat int, tpair string, pairs int")


def _pairs():
    wanted = {f"{a} {b}" for t in [*BASE, *MORE] for a, b in zip(t.split(), t.split()[1:])}

    def run(batches):
        for batch in batches:
            counts, hits = [], []
            for text in batch.column("text").to_pylist():
                words = WORD.findall((text or "").translate(LOWER))
                counts.append(len(words))
                joined = zip(words, words[1:])
                hits.append([{"at": i, "pair": p} for i, p in enumerate(map(" ".join, joined)) if p in wanted])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.struct([("at", pa.int64()), ("pair", pa.string())])))], [ROW, "_id", "n_words", "_hits"])

    return run


def verified(hits: list[tuple[int, int]], pairs: int, need: float) -> list[tuple[int, int, int]]:
    """(template places found, start, end) of the parts of a span that agree with a template of so many pairs.

    hits are (place in the text, place in the template). A part is a chain rising in both places, so a
    place of the template counts once, over at most twice the words of the template. Parts with more
    places come first, then shorter ones, and no two overlap.
    """
    # late[j][c]: latest start of a chain of c places that ends at place j - 1 of the template or before.
    late = [[-1] * (pairs + 1) for _ in range(pairs + 1)]
    found = []
    for at, place in sorted(hits, key=lambda h: (h[0], -h[1])):
        for c in range(place + 1, 0, -1):
            start = at if c == 1 else late[place][c - 1]
            if start < 0:
                continue
            if c >= need and at + 2 - start <= 2 * (pairs + 1):
                found.append((c, start, at + 2))
            for j in range(place + 1, pairs + 1):
                if late[j][c] >= start:
                    break
                late[j][c] = start
    out: list[tuple[int, int, int]] = []
    used: set[int] = set()
    for c, start, end in sorted(found, key=lambda f: (-f[0], f[2] - f[1], f[1])):
        if used.isdisjoint(range(start, end)):
            used.update(range(start, end))
            out.append((c, start, end))
    return out


def _verify(share: float):
    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                hits = [(h["at"], h["tat"]) for h in r["hits"]]
                rows += [(r[ROW], r["label"], False, start, end, c / r["pairs"]) for c, start, end in verified(hits, r["pairs"], share * r["pairs"])]
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [ROW, "label", "base", "start", "end", "score"])

    return run


def scan(docs: DataFrame, text: str = "text", ident: str = "doc_id", share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """(documents: _row, _id, n_words; spans: _row, label, base, start, end, score).

    A null text has no words. Pairs no template has are dropped before the join, which only saves
    moving them. Repeated rows are scanned each. Empty table: no rows.
    """
    kind = docs.schema[ident].dataType.simpleString()
    words = settled(map_arrow(docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident).alias("id"), F.col(text).alias("text")), _pairs(),
                              f"{ROW} long, _id {kind}, n_words long, _hits array<struct<at: bigint, pair: string>>"), "license-words")
    votes = words.select(ROW, F.inline("_hits")).join(template_pairs(docs.sparkSession), F.col("pair") == F.col("tpair")).withColumn("diagonal", F.col("at") - F.col("tat"))
    lines = votes.groupBy(ROW, "template", "label", "base", "pairs", "diagonal").agg(F.count("*").alias("votes"), F.min("at").alias("start"), (F.max("at") + 2).alias("end"), F.collect_list(F.struct("at", "tat")).alias("hits"))
    exact = lines.where("base and votes = pairs")
    # Further templates: diagonals next to each other, whose places are near, are one span.
    near = W.partitionBy(ROW, "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(near) > GAP) | (F.col("start") - F.lag("end").over(near) > GAP)
    merged = lines.where("not base").withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_span", F.sum("_new").over(near))
    spans = merged.groupBy(ROW, "template", "label", "pairs", "_span").agg(F.flatten(F.collect_list("hits")).alias("hits"))
    # A span with too few places of the template cannot hold a finding.
    spans = spans.where(F.size(F.array_distinct(F.transform("hits", lambda h: h["tat"]))) >= share * F.col("pairs"))
    fuzzy = map_arrow(spans.select(ROW, "label", "pairs", "hits"), _verify(share), f"{ROW} long, label string, base boolean, start long, end long, score double")
    cols = [ROW, "label", "base", "start", "end"]
    exact = exact.select(*cols, F.lit(1.0).alias("score"))
    return words.select(ROW, "_id", "n_words"), exact.union(fuzzy.select(*cols, "score"))


def scan_documents(docs: DataFrame, **options) -> DataFrame:
    """One row per row of docs with the spans summed up."""
    words, spans = scan(docs, **options)
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    base = F.col("base")
    found = spans.groupBy(ROW).agg(F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
                                   labels(F.when(base, F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("score").alias("score"))
    return words.join(found, ROW, "left").select("_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
