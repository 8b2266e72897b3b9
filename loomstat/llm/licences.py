"""Licence scans, natively: a positional rare-token index over licence templates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: What stands between words: ASCII but digits and lower-case letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """Words of a licence notice. ``key`` is the phrase in it that a match must hold in full; of the rest, idf-weighted
    ``cover`` must be there at the same relative positions."""

    label: str
    text: str
    key: str
    cover: float = 0.7


#: The phrases of the contract: they count only in full.
BASE = (
    Template("cc-by", "cc by", "cc by", 1.0),
    Template("gpl", "general public license", "general public license", 1.0),
    Template("reserved", "all rights reserved", "all rights reserved", 1.0),
)
#: Opening notices of common licences.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("mit", "released under the mit license", "the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", "general public license version 2"),
    Template("lgpl", "under the terms of the gnu lesser general public license", "lesser general public license"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    Template("cc0", "the author has waived all copyright and related rights", "waived all copyright"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)
#: Candidates are coded as template * SPAN + start + AHEAD; a template may start before the text does.
SPAN, AHEAD = 1 << 40, 1 << 10


def words(text: Column) -> Column:
    """The text's words after A-Z are lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP), "")


def strings(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values))


def document_frequencies(docs: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """In how many documents each licence word stands; over all documents, at most one row per licence word returned."""
    found = docs.select(F.explode(F.array_intersect(words(F.col("text")), strings(vocabulary))).alias("w"))
    return {w: n for w, n in found.groupBy("w").count().collect()}


def scan(docs: DataFrame, base: Sequence[Template] = BASE, notices: Sequence[Template] = NOTICES) -> DataFrame:
    """Licence places and labels of each text, one row per row of ``docs`` (doc_id, text), in one pass without a shuffle.

    Inverse document frequencies of the licence words come from a pass over all documents. A text can hold a template
    only if it holds every word of its key phrase; of each such template the text's two highest-idf words within the
    key phrase are looked up in the index. A posting and a position give a (template, start), and the postings of the
    two words are intersected by it: only starts on which both agree are compared, word by word at the same relative
    positions. A notice counts if its key phrase stands there in full and the idf-weighted share of matching words
    reaches its cover; a base phrase counts in full only. As a place holds its whole key phrase, none is missed.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (the largest share among what
    counts, 0 without) and ``places``: array of (label, start, cover) for all that count. Null texts are empty: no
    words, no places, labels "". Repeated rows stay rows; columns of ``docs`` other than doc_id and text are not read.
    """
    templates = [*base, *notices]
    split = [t.text.split() for t in templates]
    vocabulary = sorted({w for ws in split for w in ws})
    n, df = docs.count(), document_frequencies(docs, vocabulary)
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) + 1e-6 for w in vocabulary}
    if any(len(ws) > AHEAD for ws in split):
        raise ValueError(f"a template may have {AHEAD} words")
    key_at = [next(k for k in range(len(ws)) if ws[k : k + len(t.key.split())] == t.key.split()) for t, ws in zip(templates, split, strict=True)]
    rarest: dict[str, list[int]] = {}
    second: dict[str, list[int]] = {}
    rare_words = []
    for i, (t, ws, first) in enumerate(zip(templates, split, key_at, strict=True)):
        best, *others = sorted(range(first, first + len(t.key.split())), key=lambda k: -idf[ws[k]])
        other = others[0] if others else best
        rarest.setdefault(ws[best], []).append(i * SPAN + AHEAD - best)
        second.setdefault(ws[other], []).append(i * SPAN + AHEAD - other)
        rare_words.append(sorted({ws[best], ws[other]}))
    by_template = lambda make: F.array(*(make(i) for i in range(len(templates))))
    text_of = by_template(lambda i: strings(split[i]))
    weight_of = by_template(lambda i: F.array(*(F.lit(idf[w]) for w in split[i])))
    key_of = by_template(lambda i: F.array(*(F.lit(key_at[i] <= k < key_at[i] + len(templates[i].key.split())) for k in range(len(split[i])))))
    info_of = by_template(
        lambda i: F.struct(
            F.lit(templates[i].label).alias("label"), F.lit(templates[i].cover).alias("least"), F.lit(i < len(base)).alias("base"), F.lit(sum(idf[w] for w in split[i])).alias("all")
        )
    )
    index = lambda postings: F.create_map(*(x for w, codes in postings.items() for x in (F.lit(w), F.array(*(F.lit(c).cast("long") for c in codes)))))

    held = lambda i: F.size(F.array_except(strings(templates[i].key.split()), "_held")) == 0
    wanted = F.array_distinct(F.flatten(F.array(*(F.when(held(i), strings(rare_words[i])).otherwise(F.array().cast("array<string>")) for i in range(len(templates))))))
    at = lambda w, i: F.when(F.array_contains("_wanted", w), F.struct(w.alias("w"), i.cast("long").alias("i")))
    seen = F.filter(F.transform("_words", at), lambda x: x.isNotNull())
    none = F.array().cast("array<bigint>")
    codes = lambda postings: F.flatten(F.transform("_seen", lambda s: F.transform(F.coalesce(F.element_at(index(postings), s["w"]), none), lambda c: c + s["i"])))

    def compared(code: Column) -> Column:
        t, start = F.shiftright(code, 40).cast("int") + 1, (code % SPAN - AHEAD)
        same = F.transform(
            F.element_at(text_of, t),
            lambda w, k: F.when(start + k < 0, False).otherwise(F.coalesce(F.get("_words", (start + k).cast("int")) == w, F.lit(False))),
        )
        return F.struct(t.alias("t"), start.alias("start"), same.alias("same"))

    def judged(x: Column) -> Column:
        info = F.element_at(info_of, x["t"])
        got = F.aggregate(F.zip_with(x["same"], F.element_at(weight_of, x["t"]), lambda s, w: F.when(s, w).otherwise(0.0)), F.lit(0.0), lambda a, b: a + b)
        key = F.forall(F.zip_with(x["same"], F.element_at(key_of, x["t"]), lambda s, k: s | ~k), lambda ok: ok)
        full = F.forall(x["same"], lambda s: s)
        cover = F.when(full, 1.0).otherwise(got / info["all"])
        counts = F.when(info["base"], full).otherwise(key & (cover >= info["least"]))
        return F.struct(info["label"].alias("label"), x["start"].alias("start"), cover.alias("cover"), info["base"].alias("base"), counts.alias("counts"))

    labels = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = F.transform("_base", lambda p: p["start"])
    return (
        docs.select("doc_id", words(F.col("text")).alias("_words"))
        .withColumn("_held", F.array_intersect("_words", strings(vocabulary)))
        .withColumn("_wanted", wanted)
        .withColumn("_seen", F.when(F.size("_wanted") > 0, seen))
        .withColumn("_codes", F.array_intersect(codes(rarest), codes(second)))
        .withColumn("_judged", F.transform(F.transform("_codes", compared), judged))
        .withColumn("places", F.coalesce(F.filter("_judged", lambda p: p["counts"]), F.array().cast("array<struct<label:string,start:bigint,cover:double,base:boolean,counts:boolean>>")))
        .withColumn("_base", F.filter("places", lambda p: p["base"]))
        .select(
            "doc_id",
            F.size("_words").cast("long").alias("n_words"),
            F.size("_base").cast("long").alias("n_base"),
            F.array_min(starts).alias("first_word"),
            F.array_max(starts).alias("last_word"),
            labels(F.col("_base")).alias("base_labels"),
            labels(F.col("places")).alias("labels"),
            F.round(F.coalesce(F.array_max(F.transform("places", lambda p: p["cover"])), F.lit(0.0)), 6).alias("score"),
            F.transform("places", lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start"), p["cover"].alias("cover"))).alias("places"),
        )
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents")).drop("places")


def sql() -> str:
    """The scan of ``documents`` in SQL: every template word at every relative position, without the index."""
    rows = ",\n  ".join(
        str((i, t.label, i < len(BASE), t.cover, k, w, start <= k < start + len(key)))
        for i, t in enumerate([*BASE, *NOTICES])
        for ws, key in [(t.text.split(), t.key.split())]
        for start in [next(k for k in range(len(ws)) if ws[k : k + len(key)] == key)]
        for k, w in enumerate(ws)
    )
    return (
        rf"""
WITH t(tid, label, base, cover, k, w, in_key) AS (VALUES
  {rows}),
d AS (SELECT row_number() OVER () AS r, doc_id,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
      FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM d),
hit AS (SELECT * FROM words WHERE w IN (SELECT w FROM t)),
idf AS (SELECT v.w, ln((1 + (SELECT count(*) FROM d))::DOUBLE / (1 + count(DISTINCT r))) + 1e-6 AS idf
        FROM (SELECT DISTINCT w FROM t) v LEFT JOIN hit ON hit.w = v.w GROUP BY v.w),
whole AS (SELECT tid, count(*) AS n, count(*) FILTER (in_key) AS n_key, sum(idf) AS every FROM t JOIN idf USING (w) GROUP BY tid),
place AS (SELECT r, tid, pos - k AS start, any_value(label) AS label, bool_and(base) AS base, any_value(cover) AS least,
                 count(*) AS n, count(*) FILTER (in_key) AS n_key, sum(idf) AS got
          FROM hit JOIN t USING (w) JOIN idf USING (w) GROUP BY r, tid, pos - k),
ok AS (SELECT r, start, label, p.base, CASE WHEN p.n = q.n THEN 1.0 ELSE got / every END AS cover
       FROM place p JOIN whole q USING (tid)
       WHERE p.n_key = q.n_key AND (p.n = q.n OR NOT p.base AND got / every >= least))
SELECT doc_id, len(any_value(ws))::BIGINT AS n_words, count(*) FILTER (base) AS n_base,
       min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, round(coalesce(max(cover), 0.0), 6)::DOUBLE AS score
FROM d LEFT JOIN ok USING (r) GROUP BY r, doc_id
"""
    )
