"""Licences in documents by a positional index of rare words, in DataFrame expressions only.

A first pass counts the documents that hold each word of the templates; only these few counts
are shuffled and collected. The index lists, for each licence template, its ``INDEXED`` words of
the highest IDF (of equal ones the longer) with their places in the template. Of a document the
words in the index are found with their places. For each template the ``LOOKED`` highest-IDF
index words that the document holds are looked up, two at least (if the template has two); a
word at place i of the document and p of the template says that the template starts at i - p,
and the starts of all looked-up words are intersected. What is left is verified: the template's
mandatory key phrases must stand at their places. All of it happens within the document's row.

The base phrases are templates as well, mandatory as a whole and with all words indexed, so
their places are found and verified in the same way, whatever the counts are.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INDEXED, LOOKED = 4, 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrases: tuple[str, ...]
    base: bool = False


# The base phrases, and notices of public licences with their key phrases.
BASE = tuple(
    Template(label, phrase, (phrase,), True)
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
)
MORE = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses", ("you may not use this file except in compliance with the license",)),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "with or without fee")),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("epl", "eclipse public license", ("eclipse public license",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty", "will the authors be held liable")),
    Template("boost", "boost software license", ("boost software license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
    Template("cc-by", "licensed under a creative commons attribution license", ("creative commons attribution",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
)


def split(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(WORD, text.lower())


def _words(text: Column) -> Column:
    """Words of a text, A-Z in lower case. Other letters may change as well, but not into a
    word of A-Z: the one that would (the Kelvin sign) is replaced first."""
    low = F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0142")))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def document_counts(docs: DataFrame, text: str, templates: tuple[Template, ...]) -> dict[str, int]:
    """Documents that hold each word of the templates, and under "" the number of documents."""
    vocabulary = sorted({w for t in templates for w in split(t.text)})
    held = F.array_intersect(_words(F.col(f"`{text}`")), F.array(*map(F.lit, vocabulary)))
    counts = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r["w"]: r["n"] for r in counts.collect()}


def index(templates: tuple[Template, ...], held: dict[str, int]) -> list[dict]:
    """For each template its rare words with their places, highest IDF first, all words with a
    weight (IDF in millionths), and its key phrases with their places. ``held``: see ``document_counts``."""

    def idf(word: str) -> int:
        return round(1_000_000 * math.log(1 + held.get("", 0) / max(held.get(word, 0), 1)))

    entries = []
    for t in templates:
        words = split(t.text)
        rare = sorted(set(words), key=lambda w: (held.get(w, 0), -len(w), words.index(w)))[:INDEXED]
        phrases = []
        for phrase in map(split, t.phrases):
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            phrases.append({"p": at, "n": len(phrase), "text": " ".join(phrase)})
        entries.append(
            {
                "label": t.label,
                "base": t.base,
                "least": min(2, len(rare)),
                "rare": [{"w": w, "p": words.index(w)} for w in rare],
                "body": [{"w": w, "p": p, "weight": idf(w)} for p, w in enumerate(words)],
                "total": sum(map(idf, words)),
                "phrases": phrases,
            }
        )
    return entries


INDEX_TYPE = (
    "array<struct<label: string, base: boolean, least: int, rare: array<struct<w: string, p: int>>, "
    "body: array<struct<w: string, p: int, weight: long>>, total: long, "
    "phrases: array<struct<p: int, n: int, text: string>>>>"
)
FOUND_TYPE = "array<struct<label: string, base: boolean, start: int, verified: boolean, share: double>>"


def _candidates(words: Column, spots: Column, present: Column, template: Column) -> Column:
    """Starts of a template in the document: (start, verified, share)."""
    looked = F.slice(F.filter(template["rare"], lambda r: F.array_contains(present, r["w"])), 1, LOOKED)

    def starts(r: Column) -> Column:
        return F.transform(F.filter(spots, lambda s: s["w"] == r["w"]), lambda s: s["i"] - r["p"])

    agreed = F.aggregate(
        looked,
        F.lit(None).cast("array<int>"),
        lambda some, r: F.when(some.isNull(), F.array_distinct(starts(r))).otherwise(F.array_intersect(some, starts(r))),
    )

    def stands(start: Column, phrase: Column) -> Column:
        at = start + phrase["p"]
        return (at >= 0) & (F.array_join(F.slice(words, F.greatest(at, F.lit(0)) + 1, phrase["n"]), " ") == phrase["text"])

    def share(start: Column) -> Column:
        met = F.aggregate(
            template["body"],
            F.lit(0).cast("long"),
            lambda have, b: have + F.when(F.get(words, start + b["p"]) == b["w"], b["weight"]).otherwise(0),
        )
        return met / template["total"]

    one = F.transform(
        agreed,
        lambda s: F.struct(
            template["label"].alias("label"),
            template["base"].alias("base"),
            s.alias("start"),
            F.forall(template["phrases"], lambda phrase: stands(s, phrase)).alias("verified"),
            share(s).alias("share"),
        ),
    )
    return F.when(F.size(looked) >= template["least"], one).otherwise(F.array().cast(FOUND_TYPE))


def find_licenses(docs: DataFrame, text: str = "text", templates: tuple[Template, ...] = BASE + MORE) -> DataFrame:
    """``docs`` with ``license_words`` (number of words) and ``licenses``: (label, base, start,
    verified, share) of each place, counted in words from 0, at which a template's looked-up words agree.

    share: the IDF-weighted share of the template's words that stand at their places. A null or
    empty text has no words and no licences. A text of one repeated phrase is searched in time
    linear in its words. Rows stay as they are, repeated ones too; columns with the two new
    names are replaced. An empty table gives no rows.
    """
    entries = index(templates, document_counts(docs, text, templates))
    vocabulary = sorted({r["w"] for e in entries for r in e["rare"]})
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("license_words", "licenses")])
    rows = docs.select(own.alias("row"), _words(F.col(f"`{text}`")).alias("words"))

    def spot(word: Column, i: Column) -> Column:
        return F.when(word.isin(vocabulary), F.struct(word.alias("w"), i.alias("i")))

    rows = rows.withColumn("spots", F.array_compact(F.transform("words", spot)))
    rows = rows.withColumn("present", F.array_distinct(F.transform("spots", lambda s: s["w"])))
    listed = F.from_json(F.lit(json.dumps(entries)), INDEX_TYPE)
    found = F.flatten(F.transform(listed, lambda t: _candidates(F.col("words"), F.col("spots"), F.col("present"), t)))
    found = F.when(F.size("spots") > 0, found).otherwise(F.array().cast(FOUND_TYPE))
    rows = rows.select("row", F.size("words").cast("long").alias("license_words"), found.alias("licenses"))
    return rows.select("row.*", "license_words", "licenses")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: the largest share of a template found in the text; one without its key phrases
    counts half and gives no label. No licence: 0 and empty labels.
    """
    found = find_licenses(docs.select("doc_id", "text"))
    sure = F.filter("licenses", lambda x: x["verified"])
    rows = found.select("doc_id", F.col("license_words").alias("n_words"), "licenses", sure.alias("sure"))
    rows = rows.withColumn("places", F.transform(F.filter("sure", lambda x: x["base"]), lambda x: x["start"].cast("long")))

    def labels(some: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(some, lambda x: x["label"]))), ",")

    weighed = F.transform("licenses", lambda x: F.when(x["verified"], x["share"]).otherwise(x["share"] / 2))
    return rows.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        labels(F.filter("sure", lambda x: x["base"])).alias("base_labels"),
        labels(F.col("sure")).alias("labels"),
        F.coalesce(F.array_max(weighed), F.lit(0.0)).alias("score"),
    )
