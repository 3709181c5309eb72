"""Licence scan by a positional index of rare words, in DataFrame functions alone.

Templates (whole permission texts of short licences, the standard notices of long ones) are indexed by their rarest
words and positions; a word's weight is its IDF over the templates. Of every file, the licence words are ranked by IDF
over all scanned texts, and the TOP_WORDS highest are looked up. Postings are intersected by relative position: words
which stand in a file as they stand in a template meet at one offset, and their weights add up to the template's score.
A template counts once its mandatory key phrases are verified: all their words consecutive. Base phrases come from the
same index and count wherever they stand consecutively.

Only files with a gate word are taken apart; equal ones once. The index is a fixed table of some hundred rows, and is
broadcast, as are the frequencies of its words. The one shuffle of words holds licence words only. A text that very many
rows share is one key of the result's join; its rows are dealt out over SALTS keys.

Defined results: a null or empty text has 0 words, no places, empty labels and score 0; first_word and last_word are
null without a base place; a text of any length is read whole; words that tie in IDF rank by spelling; repeated rows
report the same; an empty table gives an empty table. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, written

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall
be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of
conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_NAMES = """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the
License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin
of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must
be plainly marked as such, and must not be misrepresented as being the original software."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate
any and all copyright interest in the software to the public domain."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit
the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do
so"""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_EPL = """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
available at https://www.eclipse.org/legal/epl-2.0/"""
_CC0 = """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this
software to the public domain worldwide. This software is distributed without any warranty. You should have received a copy of the
CC0 Public Domain Dedication along with this software."""
#: Fixed values: (label, text, mandatory key phrases), the wording of public licences and their notices.
TEMPLATES = [
    ("mit", _MIT, ["permission is hereby granted free of charge", "to deal in the software without restriction"]),
    ("apache", _APACHE, ["except in compliance with the license"]),
    ("gpl", _GPL, ["gnu general public license"]),
    ("lgpl", _GPL.replace("program", "library").replace("General", "Lesser General"), ["gnu lesser general public license"]),
    ("agpl", _GPL.replace("General", "Affero General"), ["gnu affero general public license"]),
    ("bsd", _BSD, ["redistribution and use in source and binary forms"]),
    ("bsd-3-clause", f"{_BSD} {_BSD_NAMES}", ["redistribution and use in source and binary forms", "neither the name of"]),
    ("isc", _ISC, ["permission to use copy modify", "with or without fee is hereby granted"]),
    ("zlib", _ZLIB, ["must not be misrepresented", "permission is granted to anyone to use this software"]),
    ("bsl", _BOOST, ["permission is hereby granted free of charge", "accompanying documentation covered by this license"]),
    ("mpl", _MPL, ["mozilla public license"]),
    ("epl", _EPL, ["eclipse public license"]),
    ("unlicense", _UNLICENSE, ["free and unencumbered software"]),
    ("cc0", _CC0, ["cc0 public domain dedication"]),
    ("cc0", "Dedicated to the public domain under the Creative Commons CC0 1.0 Universal license", ["creative commons cc0"]),
    ("cc-by", "Licensed under CC BY 4.0", ["licensed under cc by 4 0"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", ["licensed under cc by sa"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["licensed under cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ["creative commons attribution noncommercial"]),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0", ["licensed under cc by nd"]),
]
#: Every key phrase and base phrase has a word that holds one of these.
GATE = ["licens", "permission", "redistribution", "unencumbered", "creative", "cc0", "misrepresented"]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a template that are posted, and of a file that are looked up, by falling IDF.
TEMPLATE_WORDS, TOP_WORDS = 32, 192
#: Words of a lower IDF, in more than a third of the templates, aren't posted for a template.
MIN_IDF = math.log(4)
#: Offsets within a band of so many words count as one alignment.
BAND = 32
MIN_SCORE = 0.6
SALTS = 16


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def index(templates: list = TEMPLATES, base: dict[str, str] = BASE) -> tuple[list[tuple], list[tuple]]:
    """Postings (word, kind, entry, position, weight) and entries (kind, entry, label, whole weight, number of key phrases)."""
    bodies = [words_of(t) for _, t, _ in templates]
    df = Counter(w for b in bodies for w in set(b))
    idf = {w: math.log(1 + len(bodies) / n) for w, n in df.items()}
    postings: list[tuple] = []
    entries: list[tuple] = []
    for k, (label, _, keys) in enumerate(templates):
        chosen = set(sorted((w for w in set(bodies[k]) if idf[w] >= MIN_IDF), key=lambda w: (-idf[w], w))[:TEMPLATE_WORDS])
        rare = [(p, w) for p, w in enumerate(bodies[k]) if w in chosen]
        postings += [(w, "template", k, p, idf[w]) for p, w in rare]
        entries.append(("template", k, label, sum(idf[w] for _, w in rare), len(keys)))
        for j, phrase in enumerate(keys):
            of_phrase = words_of(phrase)
            postings += [(w, "key", 100 * k + j, p, 1.0) for p, w in enumerate(of_phrase)]
            entries.append(("key", 100 * k + j, label, float(len(of_phrase)), 0))
    for k, (phrase, label) in enumerate(base.items()):
        of_phrase = words_of(phrase)
        postings += [(w, "base", k, p, 1.0) for p, w in enumerate(of_phrase)]
        entries.append(("base", k, label, float(len(of_phrase)), 0))
    return postings, entries


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def places(texts: DataFrame, templates: list = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """Of (__key, __low): n_base, first_word, last_word, labels and score by key; one row for each key that has any."""
    spark = texts.sparkSession
    postings, entries = index(templates, base)
    posted = F.broadcast(spark.createDataFrame(postings, "__word string, __kind string, __entry int, __at int, __weight double"))
    known = F.broadcast(spark.createDataFrame(entries, "__kind string, __entry int, __label string, __whole double, __n_keys int"))
    vocabulary = sorted({p[0] for p in postings})
    parted = texts.select("__key", F.regexp_extract_all("__low", F.lit(WORD), F.lit(0)).alias("__words"))
    held = parted.withColumn("__held", F.array_intersect("__words", F.array(*map(F.lit, vocabulary))))
    # One row: how many texts hold each word of the vocabulary.
    counted = held.select(F.explode("__held").alias("__word")).groupBy("__word").agg(F.count(F.lit(1)).alias("__df"))
    df = F.broadcast(counted.agg(F.map_from_entries(F.collect_list(F.struct("__word", "__df"))).alias("__dfs")))
    # Of every file, its licence words by falling IDF over all texts; phrases look up all theirs.
    ranked = held.join(df).withColumn("__top", F.slice(F.array_sort(F.transform("__held", lambda w: F.struct(F.col("__dfs")[w].alias("n"), w.alias("w")))), 1, TOP_WORDS)["w"])
    every = ranked.select("__key", "__top", F.posexplode("__words").alias("__pos", "__word"))
    hits = every.where(F.col("__word").isin(vocabulary)).select("__key", "__pos", "__word", F.array_contains("__top", F.col("__word")).alias("__is_top"))
    aligned = hits.join(posted, "__word").where((F.col("__kind") != "template") | F.col("__is_top")).withColumn("__offset", F.col("__pos") - F.col("__at"))
    # A template's offsets meet in bands that overlap by half; a phrase's must be equal.
    half = F.floor(F.col("__offset") / F.lit(BAND // 2)).cast("long")
    bands = F.when(F.col("__kind") == "template", F.array(half, half - 1)).otherwise(F.array(F.col("__offset").cast("long")))
    spread = aligned.select("__key", "__kind", "__entry", "__at", "__weight", F.explode(bands).alias("__band"))
    # Each position of an entry counts once in a band.
    once = spread.groupBy("__key", "__kind", "__entry", "__band", "__at").agg(F.first("__weight").alias("__weight"))
    found = once.groupBy("__key", "__kind", "__entry", "__band").agg(F.sum("__weight").alias("__sum")).join(known, ["__kind", "__entry"])
    is_phrase = F.col("__kind") != "template"
    good = found.where(F.when(is_phrase, F.col("__sum") >= F.col("__whole")).otherwise(F.col("__sum") >= MIN_SCORE * F.col("__whole")))
    by_entry = good.groupBy("__key", "__kind", "__entry", "__label", "__n_keys").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__band").alias("__first"), F.max("__band").alias("__last"), F.max(F.col("__sum") / F.col("__whole")).alias("__score")
    )
    # Key phrases join their template: entry 100 * k + j is a phrase of template k.
    template = F.when(F.col("__kind") == "key", F.floor(F.col("__entry") / 100)).otherwise(F.col("__entry")).cast("int")
    group = F.when(F.col("__kind") == "base", "base").otherwise("template")
    merged = by_entry.groupBy("__key", group.alias("__group"), template.alias("__template"), "__label").agg(
        F.max(F.when(F.col("__kind") != "key", F.col("__score"))).alias("__score"),
        F.sum(F.when(F.col("__kind") == "key", 1).otherwise(0)).alias("__keys"),
        F.max("__n_keys").alias("__n_keys"),
        F.sum(F.when(F.col("__kind") == "base", F.col("__n"))).alias("__n"),
        F.min(F.when(F.col("__kind") == "base", F.col("__first"))).alias("__first"),
        F.max(F.when(F.col("__kind") == "base", F.col("__last"))).alias("__last"),
    )
    is_base = F.col("__group") == "base"
    verified = merged.where(is_base | (F.col("__score").isNotNull() & (F.col("__keys") >= F.col("__n_keys"))))
    return verified.groupBy("__key").agg(
        F.sum("__n").alias("__n_base"),
        F.min("__first").alias("__first_word"),
        F.max("__last").alias("__last_word"),
        _joined(F.collect_list(F.when(is_base, F.col("__label")))).alias("__base_labels"),
        _joined(F.collect_list("__label")).alias("__labels"),
        F.max("__score").alias("__score"),
    )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list = TEMPLATES, base: dict[str, str] = BASE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    content = column(text)
    lower = F.lower(content)
    gated = F.lit(False)
    for word in GATE:
        gated = gated | F.contains(lower, F.lit(word))
    gated = F.coalesce(gated, F.lit(False))
    salt = F.pmod(F.xxhash64(column(doc_id), F.monotonically_increasing_id()), F.lit(SALTS))
    slim = docs.select(
        column(doc_id).alias("doc_id"),
        F.coalesce(F.regexp_count(content, F.lit(WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"),
        # Rows without a gate word get keys of their own, spread over all tasks.
        F.coalesce(F.when(gated, F.md5(content.cast("binary"))), F.concat(F.lit("-"), F.xxhash64(column(doc_id), content).cast("string"))).alias("__key"),
        salt.alias("__salt"),
    )
    chosen = docs.where(gated).select(F.md5(content.cast("binary")).alias("__key"), F.translate(content, UPPER, LOWER).alias("__low"))
    # Equal texts are taken apart once.
    single = written(chosen.groupBy("__key").agg(F.first("__low").alias("__low")))
    found = places(single, templates, base).withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return slim.join(found, ["__key", "__salt"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("__n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("__first_word").cast("long").alias("first_word"),
        F.col("__last_word").cast("long").alias("last_word"),
        F.coalesce("__base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("__labels", F.lit("")).alias("labels"),
        F.least(F.coalesce("__score", F.lit(0.0)), F.lit(1.0)).alias("score"),
    )
