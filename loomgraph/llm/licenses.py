"""License scans: a positional index of rare words of license templates, in DataFrame functions only.

A document's words that occur in any template are looked up, those of highest IDF first: for every template whose key words the
document has, its rarest words there (document frequencies are counted over all documents) vote for the places at which the
template could start, place in the document less place in the template. A place that more than half of them agree on is
verified: the mandatory key phrases of the template must stand there, word for word; its score is the share of the template's
words that do.

All of it happens within a document's row, in time n log n of its words; only the document frequencies of the templates' words (a
few hundred numbers, whatever the corpus) leave it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of lower-cased text: a-z, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that count wherever they stand, and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How many of a template's words in a document are looked up, rarest first.
LOOKUPS = 5

# Wording of public licenses and of the notices that name them. (label, passage, mandatory key phrases)
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License Version 2 0",)),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", ("distributed under the License is distributed on an AS IS BASIS",)),
    ("mit", "Released under the MIT License", ("MIT License",)),
    ("mit", "SPDX-License-Identifier: MIT", ("License Identifier MIT",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ("Permission is hereby granted free of charge", "to deal in the Software without restriction")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("bsd-3-clause", "may be used to endorse or promote products derived from this software without specific prior written permission", ("endorse or promote products derived from this software",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("GNU General Public License version 2",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("GNU General Public License version 3",)),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("GNU General Public License as published by the Free Software Foundation", "version 2 of the License")),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("GNU General Public License as published by the Free Software Foundation", "version 3 of the License")),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("GNU Lesser General Public License",)),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("GNU Affero General Public License",)),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License v 2 0",)),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", ("Eclipse Public License 2 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("CC BY 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("CC BY SA 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("CC BY NC 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("CC BY ND 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4 0 International License",)),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution ShareAlike 4 0 International License",)),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution NonCommercial 4 0 International License",)),
    ("cc0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("reserved", "Copyright. All rights reserved.", ("All rights reserved",)),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _keys(words: list[str], phrases) -> list[int]:
    """Places in a template of the words of its key phrases; a phrase that the template lacks is a mistake in the template."""
    out: set[int] = set()
    for phrase in map(words_of, phrases):
        at = [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
        if not phrase or not at:
            raise ValueError(f"key phrase {phrase} does not stand in its template")
        out |= set(range(at[0], at[0] + len(phrase)))
    if not out:
        raise ValueError("a template needs a key phrase")
    return sorted(out)


def vocabulary(templates=TEMPLATES) -> list[str]:
    """The words that a scan looks at."""
    return sorted({w for _, text, _ in templates for w in words_of(text)} | {w for phrase, _ in BASE for w in phrase.split()})


def licence_words(docs: DataFrame, vocab: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` and `low`: for each word of the whole text, itself in lower case if vocab has it, else null.

    The Kelvin sign is the one character outside ASCII whose lower case is an ASCII letter alone; it gives way to another letter
    first, so that only A-Z become letters of vocab."""
    text = F.lower(F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("\u212a"), F.lit("\u0138")))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return docs.select(*keep, F.transform(words, lambda w: F.when(w.isin(vocab), w)).alias("low"))


def document_frequencies(docs: DataFrame, vocab: list[str]) -> dict[str, int]:
    """In how many documents each word of vocab stands; words in none are left out. As many rows as vocab has at most."""
    w = licence_words(docs, vocab).select(F.explode(F.array_distinct(F.array_compact("low"))).alias("w"))
    return {r["w"]: r["n"] for r in w.groupBy("w").agg(F.count("*").alias("n")).collect()}


def _index(templates, df: dict[str, int]) -> Column:
    """The templates as one constant: label, words, key places and distinct words by falling IDF, each with its places."""
    strings = lambda xs: F.array(*map(F.lit, xs))
    out = []
    for label, text, phrases in templates:
        words = words_of(text)
        keys = _keys(words, phrases)
        rare = sorted(set(words), key=lambda w: (df.get(w, 0), w.encode()))
        postings = F.array(*[F.struct(F.lit(w).alias("w"), F.array(*[F.lit(i) for i, x in enumerate(words) if x == w]).alias("at")) for w in rare])
        needed = sorted({words[i] for i in keys}, key=lambda w: (df.get(w, 0), w))
        out.append(F.struct(F.lit(label).alias("label"), strings(words).alias("words"), F.array(*map(F.lit, keys)).alias("keys"), strings(needed).alias("needed"), postings.alias("rare")))
    return F.array(*out)


def _base(low: Column, present: Column) -> Column:
    """Places and labels of the base phrases; texts that lack a word of each phrase are not searched."""
    def label(w: Column, i: Column) -> Column:
        c = F.lit(None).cast("string")
        for phrase, name in BASE:
            first, *rest = phrase.split()
            on = w == first
            for k, x in enumerate(rest, 1):
                on = on & (F.get(low, i + k) == x)
            c = F.when(on, F.lit(name)).otherwise(c)
        return F.when(w.isin([phrase.split()[0] for phrase, _ in BASE]), F.struct(i.alias("at"), c.alias("label")))

    some = F.lit(False)
    for phrase, _ in BASE:
        every = F.lit(True)
        for w in phrase.split():
            every = every & F.array_contains(present, w)
        some = some | every
    return F.filter(F.transform(F.when(some, low).otherwise(F.slice(low, 1, 0)), label), lambda x: x["label"].isNotNull())


def _places(low: Column, present: Column, t: Column, lookups: int) -> Column:
    """Where template t could start: places that more than half of the words looked up agree on, in order."""
    seen = F.slice(F.filter(t["rare"], lambda r: F.array_contains(present, r["w"])), 1, lookups)
    votes = F.transform(
        seen,
        lambda r: F.array_distinct(F.flatten(F.transform(F.filter(F.transform(low, lambda w, i: F.when(w == r["w"], i)), lambda i: i.isNotNull()), lambda i: F.transform(r["at"], lambda j: i - j)))),
    )
    more = F.floor(F.size(seen) / 2).cast("int")  # places after the first of an equal run that reach a majority
    ordered = F.array_sort(F.flatten(votes))
    return F.transform(F.array(F.struct(ordered.alias("o"), more.alias("m"))), lambda x: F.array_distinct(F.array_compact(F.transform(x["o"], lambda o, i: F.when(F.get(x["o"], i + x["m"]) == o, o)))))[0]


def _verified(low: Column, t: Column, place: Column) -> Column:
    """How many words of t stand at the place, and whether all of its key phrases do."""
    same = F.filter(F.sequence(F.lit(0), F.size(t["words"]) - 1), lambda j: F.get(low, place + j) == F.get(t["words"], j))
    return F.struct(t["label"].alias("label"), place.alias("place"), same.alias("same"), F.size(t["words"]).alias("length"), t["keys"].alias("keys"))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, lookups: int = LOOKUPS, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: doc_id, the columns `carry`, n_words, base (places and labels of the base phrases), found
    (label, place, matched, length of each verified template, by template and place), base_labels and labels (distinct, sorted,
    comma-joined), score (the best share of a template's words that stand at a verified place, else 0).

    Null and empty texts have no words, no labels and score 0. Null and repeated ids and repeated rows are rows like any others,
    further columns play no part, whatever their names; an empty table gives an empty result. Document frequencies count rows;
    equal ones go by the word. Very long texts are read whole."""
    vocab = vocabulary(templates)
    index = _index(templates, document_frequencies(docs, vocab))
    own = docs.select(F.col("doc_id"), *[F.col(c) for c in carry], F.col("text"))
    x = licence_words(own, vocab, ("doc_id", *carry))
    x = x.select("doc_id", *carry, "low", F.array_distinct(F.array_compact("low")).alias("present"))
    known = lambda t: F.forall(t["needed"], lambda w: F.array_contains(F.col("present"), w))
    x = x.select("*", _base(F.col("low"), F.col("present")).alias("base"), F.filter(index, known).alias("near"))
    place = lambda t: F.transform(_places(F.col("low"), F.col("present"), t, lookups), lambda o: _verified(F.col("low"), t, o))
    x = x.select("doc_id", *carry, F.size("low").cast("long").alias("n_words"), "base", F.flatten(F.transform("near", place)).alias("hits"))
    whole = F.filter("hits", lambda h: F.size(F.array_except(h["keys"], h["same"])) == 0)
    found = F.transform(whole, lambda h: F.struct(h["label"].alias("label"), h["place"].cast("long").alias("place"), F.size(h["same"]).alias("matched"), h["length"].alias("length")))
    x = x.select("doc_id", *carry, "n_words", "base", found.alias("found"))
    of_base, of_found = F.transform("base", lambda b: b["label"]), F.transform("found", lambda f: f["label"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.coalesce(F.array_max(F.transform("found", lambda f: f["matched"] / f["length"])), F.lit(0.0))
    return x.select("doc_id", *carry, "n_words", "base", "found", joined(of_base).alias("base_labels"), joined(F.concat(of_base, of_found)).alias("labels"), score.alias("score"))
