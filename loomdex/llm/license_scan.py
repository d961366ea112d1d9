"""License scans by diagonal voting.

The hash of every run of K words of a text is joined to the positions of the
same run in license templates, a fixed small table. A match at word i of a text and
word j of a template votes for the diagonal i - j; votes are aggregated by
diagonal, neighbouring diagonals are merged (words inserted or missing shift them), and the
words of each candidate span are then compared with the template itself.
"""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomdex.llm.words import hashed, rolling
from loomdex.runtime import materialize

#: Words of a run; diagonals that merge; share of a template that a verified span has.
K, NEIGHBOURS, LEAST_SHARE = 4, 8, 0.6

# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Public license texts and notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
specific language governing permissions and limitations under the License."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version."""),
    ("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your
option) any later version."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version."""),
    ("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright
notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: Bytes of words ([0-9a-z] after lower-casing A-Z, and all of longer UTF-8 sequences); others become spaces.
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def _grams(text: str | None) -> np.ndarray:
    """The hash of each run of K words, as signed integers."""
    words = words_of(text)
    return rolling(hashed(words, len(words)), K).view(np.int64)


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of each place where a base phrase stands."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in BASE:
        needle = b" " + phrase.encode() + b" "
        at, seen, upto = line.find(needle), 0, 0
        while at >= 0:
            seen += line.count(b" ", upto, at)
            found.append((seen, label))
            upto, at = at, line.find(needle, at + 1)
    return sorted(found)


@lru_cache(maxsize=1)
def _template_set() -> np.ndarray:
    """Sorted hashes of all runs of K words of the templates."""
    return np.unique(np.concatenate([_grams(text) for _, text in TEMPLATES]))


def _read(text: str | None) -> tuple:
    """(words, base places, first and last of them, base labels, places and hashes of runs of K words that some template has)."""
    words = words_of(text)
    places, grams, known = base_places(words), _grams(text), _template_set()
    at = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams) if len(grams) else ()
    runs = [{"i": int(i), "g": int(grams[i])} for i in at]
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({p[1] for p in places}), runs


def template_grams(spark: SparkSession) -> DataFrame:
    """``(g, template, t)``: hash and position of each run of K words of each template."""
    rows = [
        (int(h), n, t)
        for n, (_, text) in enumerate(TEMPLATES)
        for t, h in enumerate(_grams(text).tolist())
    ]
    return spark.createDataFrame(rows, "g long, template int, t int")


def candidate_spans(found: DataFrame) -> DataFrame:
    """``(row, template, first, last)``: word ranges where merged diagonals have votes enough, of ``found(row, runs)``."""
    spark = found.sparkSession
    rolled = found.select("row", F.explode("runs").alias("run")).select("row", "run.i", "run.g")
    # The templates are the fixed ones above: a few hundred rows on any input.
    votes = rolled.join(F.broadcast(template_grams(spark)), "g")
    diagonals = votes.groupBy("row", "template", (F.col("i") - F.col("t")).alias("diagonal")).agg(
        F.collect_set("t").alias("ts"), F.min("i").alias("first"), F.max("i").alias("last")
    )
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = (F.col("diagonal") - F.lag("diagonal").over(line) > NEIGHBOURS).cast("int")
    merged = diagonals.withColumn("run", F.sum(F.coalesce(apart, F.lit(0))).over(line))
    spans = merged.groupBy("row", "template", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("votes"),
        F.min("first").alias("first"),
        (F.max("last") + K).alias("last"),
    )
    sizes = F.element_at(F.array(*[F.lit(len(words_of(t)) - K + 1) for _, t in TEMPLATES]), F.col("template") + 1)
    return spans.where(F.col("votes") * 3 >= sizes).select("row", "template", "first", "last")


def span_share(words: list[bytes], template: int, first: int, last: int) -> float:
    """Share of the template's words that stand, in order, in a range of words; blocks of K words count."""
    wanted = words_of(TEMPLATES[template][1])
    blocks = SequenceMatcher(None, wanted, words[first:last], autojunk=False).get_matching_blocks()
    least = min(K, len(wanted))
    return sum(b.size for b in blocks if b.size >= least) / len(wanted)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)`` of each row of ``docs``.

    n_base counts the places of base phrases, first_word and last_word are the smallest and
    largest word at which one starts (else null). labels adds those of verified spans. score
    is 1 with a base phrase, else the largest share of a template that a verified span
    has, else 0. spans lists (label, first, last, share). Null text is empty: no words, no labels. Rows that repeat count each;
    other columns are left out, whatever their names; an empty table gives no rows.

    Texts are read once. What is written of them is what was found, and the whole text of rows that have a run of words of
    some template: only those are joined with their spans.
    """

    schema = "n_words long, n_base long, first_word long, last_word long, base array<string>, runs array<struct<i:int,g:long>>"
    columns = [c.split()[0] for c in schema.split(", ")]

    @F.pandas_udf(schema)
    def read(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(list(map(_read, texts)), columns=columns).astype({"first_word": "Int64", "last_word": "Int64"})

    @F.pandas_udf("array<struct<label:string,first:int,last:int,share:double>>")
    def verified(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, candidates in zip(texts, found, strict=True):
            kept = []
            if candidates is not None and len(candidates):
                words = words_of(text)
                for c in candidates:
                    share = span_share(words, c["template"], c["first"], c["last"])
                    if share >= LEAST_SHARE:
                        kept.append({"label": TEMPLATES[c["template"]][0], "first": c["first"], "last": c["last"], "share": share})
            out.append(kept)
        return pd.Series(out)

    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), read(docs["text"]).alias("b"))
    text = F.when(F.size("runs") > 0, F.col("text")).alias("text")
    rows = rows.select("doc_id", "b.*", "text").select("doc_id", *columns, text, F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "read")
    some = rows.where(F.size("runs") > 0)
    listed = candidate_spans(some).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("template", "first", "last"))).alias("found"))
    none = F.array().cast("array<struct<label:string,first:int,last:int,share:double>>").alias("spans")
    kept = ["doc_id", *columns[:-1]]
    met = some.select(*kept, "text", "row").join(listed, "row", "left").select(*kept, verified("text", "found").alias("spans"))
    told = rows.where(F.size("runs") == 0).select(*kept, none).unionByName(met)
    every = F.array_sort(F.array_distinct(F.concat("base", F.col("spans.label"))))
    return told.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))).alias("score"),
        "spans",
    )
