"""Operator 9 [native]: licence scans with a positional rare-token index.

The index has postings (word, template, position) of the RARE places of each template's mandatory key phrase whose words are the
rarest in all documents. A file's words are looked up in it, each hit being a place where a template would begin; where all of a
template's postings give the same place, by their positions, it is a candidate. A key phrase stands nowhere else, so none
is missed, and common words are never looked up. A candidate is verified: its key phrase must stand there word by word, and
LEAST of all the template's words in their places. Its score is that share. Beside it the base phrases are found wherever
their words stand consecutively.

Document frequencies of the key phrases' words are counted over all documents. They are a fixed number, so the driver takes
them as a small dictionary, and the index is a table of some hundred rows. Only files with a word that some phrase or key
phrase must have are looked up; no other can be labelled. Copies of a file are looked up once, and a file that very many
documents copy is joined back by itself.

Templates are short notices and passages of the licences' own texts, as words. A passage that was changed in places still
counts, with a lower score; the words of a long notice's key phrase alone, in prose, do not.

Nulls: a null text is an empty one; rows with null or repeated doc_id are scanned like others; an empty table gives an
empty result. Other columns are not read."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_unique

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: label: (template, mandatory key phrase).
TEMPLATES = {
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "apache-2": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "cc-by-nc": ("licensed under cc by nc 4 0", "cc by nc"),
    "cc-by-sa": ("licensed under cc by sa 4 0", "cc by sa"),
    "mit-notice": ("released under the mit license", "the mit license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license"),
    "mpl": ("subject to the terms of the mozilla public license", "mozilla public license"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished"
        " to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "free of charge to any person obtaining a copy of this software and associated documentation files",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "distribute this software for any purpose with or without fee is hereby granted"),
    "bsd-2": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    "bsd-3": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    "apache-2-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"
        " without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "you may not use this file except in compliance with the license",
    ),
    "gpl-2-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 2"),
    "gpl-3-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu general public license as published by the free software foundation either version 3"),
    "lgpl-notice": ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "gnu lesser general public license as published by the free software foundation"),
    "agpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "terms of the mozilla public license v 2 0"),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    "boost": ("distributed under the boost software license version 1 0", "boost software license version 1 0"),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    "cc-by-text": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    "cc-by-sa-text": ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international license"),
    "cc-by-nc-text": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international license"),
}
#: The words whose document frequencies are counted: those of the key phrases.
VOCABULARY = sorted({w for _, k in TEMPLATES.values() for w in k.split()})
#: Of a key phrase, the places whose words are looked up; the least share of a template's words in their places.
RARE, LEAST = 4, 0.3
#: Capitals that are lowered: A-Z alone, as the words' definition has it.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A labelled file has one of these words: the longest of each base phrase and key phrase.
SIGNS = sorted({max(p.split(), key=len) for p in (*BASE, *(k for _, k in TEMPLATES.values()))} - {"by"} | {"cc"})


def _starts(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively."""
    first, *rest = phrase.split()

    def stands(i: Column) -> Column:
        out = F.get(words, i) == first
        for j, w in enumerate(rest, 1):
            out &= F.coalesce(F.get(words, i + j) == w, F.lit(False))
        return out

    return F.filter(F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1)).otherwise(F.expr("cast(array() as array<int>)")), stands)


def rare_postings(rarity: dict[str, float], rare: int = RARE) -> list[tuple[str, str, int]]:
    """(word, label, position in the template) of each key phrase's rarest places."""
    out = []
    for label, (template, key) in TEMPLATES.items():
        said, own = template.split(), key.split()
        before = next(k for k in range(len(said)) if said[k : k + len(own)] == own)
        out += [(own[j], label, before + j) for j in sorted(range(len(own)), key=lambda j: (-rarity[own[j]], j))[:rare]]
    return out


def _verified(candidates: Column, words: Column) -> Column:
    """(label, score) of the candidates (label, start) whose key phrase stands there and LEAST of whose words do."""
    told = {}
    for label, (template, key) in TEMPLATES.items():
        said, own = template.split(), key.split()
        before = next(k for k in range(len(said)) if said[k : k + len(own)] == own)
        told[label] = F.struct(F.array(*map(F.lit, said)).alias("said"), F.array(*map(F.lit, own)).alias("key"), F.lit(before).alias("before"))
    templates = F.create_map(*(x for label, t in told.items() for x in (F.lit(label), t)))
    stands = lambda said, start: F.size(F.filter(said, lambda w, j: F.coalesce(F.get(words, start + j) == w, F.lit(False))))

    def judged(c: Column) -> Column:
        t = F.element_at(templates, c["label"])
        whole = stands(t["key"], c["start"] + t["before"]) == F.size(t["key"])
        return F.struct(c["label"].alias("label"), F.when(whole, stands(t["said"], c["start"]) / F.size(t["said"])).alias("score"))

    return F.filter(F.transform(candidates, judged), lambda x: x["score"] >= LEAST)


def candidates(files: DataFrame, postings: list[tuple[str, str, int]]) -> DataFrame:
    """(file, candidates array<struct<label, start>>) of files (file, words) where all of a template's postings meet; start may be before the file's first word."""
    book = files.sparkSession.createDataFrame(postings, "word string, label string, at int")
    need = book.groupBy("label").agg(F.count("*").alias("need"))
    index = cut(book.join(need, "label"))  # some hundred rows
    looked = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda x: x["word"].isin(sorted({w for w, *_ in postings})))
    hits = files.select("file", F.explode(looked).alias("hit")).select("file", "hit.word", "hit.i").join(F.broadcast(index), "word")
    met = hits.groupBy("file", "label", (F.col("i") - F.col("at")).alias("start"), "need").agg(F.count("*").alias("n")).where("n = need")
    return met.groupBy("file").agg(F.collect_list(F.struct("label", "start")).alias("candidates"))


def scan(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n_words, the base places and labels, all labels, score (the best accepted template's share of words in their places)."""
    text = F.translate(F.coalesce("text", F.lit("")), CAPITALS, CAPITALS.lower())
    words = docs.select("doc_id", F.filter(F.split(text, SEPARATORS), lambda w: w != "").alias("words"))
    # Texts are read and split once; the arrays stay only in files that have a sign.
    read = cut(
        words.select(
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.array_distinct(F.filter("words", lambda w: w.isin(VOCABULARY))).alias("licence_words"),
            F.when(F.exists("words", lambda w: w.isin(SIGNS)), F.col("words")).alias("words"),
        )
    )
    counts = {r[0]: r[1] for r in read.select(F.explode("licence_words").alias("w")).groupBy("w").count().collect()}  # len(VOCABULARY) rows at most
    total = max(1, read.count())
    rarity = {w: math.log((1 + total) / (1 + counts.get(w, 0))) for w in VOCABULARY}

    none = [F.lit(0).cast("long").alias("n_base"), *(F.lit(None).cast("long").alias(c) for c in ("first_word", "last_word")), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score")]
    plain = read.where("words is null").select("doc_id", "n_words", *none)
    signed = read.where("words is not null").withColumn("file", F.sha2(F.array_join("words", " "), 256))
    # Copies of a file are looked up once.
    files = signed.groupBy("file").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    found = files.join(candidates(files, rare_postings(rarity)), "file").select("file", "copies", _verified(F.col("candidates"), F.col("words")).alias("found"))
    accepted = found.where(F.size("found") > 0).select("file", "copies", F.array_distinct(F.col("found.label")).alias("found"), F.array_max(F.col("found.score")).alias("score"))

    based = signed.select("doc_id", "n_words", "file", F.array(*(_starts(F.col("words"), p) for p in BASE)).alias("starts"))
    names = F.array(*(F.when(F.size(F.col("starts")[k]) > 0, F.lit(label)) for k, label in enumerate(BASE.values())))
    based = based.select("doc_id", "n_words", "file", F.flatten("starts").alias("at"), F.array_sort(F.array_compact(names)).alias("base"))
    out = join_unique(based, accepted, "file", "copies", signed.count(), "left").select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("found", F.expr("cast(array() as array<string>)")))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
    return plain.union(out)
