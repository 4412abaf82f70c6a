"""License scans: MinHash bands over overlapping windows retrieve templates.

Words are runs of letters and digits (inner dots and hyphens stay), in lower
case. A five-word shingle of a template is made of template words only, so only
runs of at least five such words can hold one: windows of 8, 16 and 32 words are
laid over those, in a document at every quarter of their size, in a template at
every word. Templates of five to seven words are one window each. Windows meet others of
their size. A window of 8
words that a document shares unchanged equals a template's window and is found
for certain, and as a template that is contained to 0.8 keeps such a window
unless its changes are spread evenly, so is the template; windows at a similarity
of 0.6 are found by ``BANDS`` bands of ``ROWS`` minima with probability
1 - (1 - 0.6**2)**20, over 0.9998. A document holds a template when at least
``CONTAINED`` of the template's shingles are among its own, exactly.

DataFrame functions only. Templates are the fixed table below, so the broadcast
of their bands has a fixed size. Texts are not moved: only documents with a run
leave the scan, with their shingles of template words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, matches, stored

#: Notices and texts of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
}
WIDTH, SIZES, BANDS, ROWS, CONTAINED = 5, (8, 16, 32), 20, 2, 0.8
WORD = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _shingles(words: Column) -> Column:
    """A run's shingles, in order."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - WIDTH + 1), lambda i: F.array_join(F.slice(words, i, WIDTH), " "))


def _bands(shingles: Column, dense: bool, sizes: tuple[int, ...]) -> Column:
    """Band keys of all windows of the sizes over one run's shingles."""

    def keys(window: Column, size: int) -> Column:
        least = F.transform(F.sequence(F.lit(1), F.lit(BANDS * ROWS)), lambda s: F.array_min(F.transform(window, lambda x: F.xxhash64(x, s))))
        return let(least, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.lit(size), b, F.slice(m, b * ROWS + 1, ROWS))))

    def sized(h: Column, size: int) -> Column:
        last, n, step = F.size(h) - (size - WIDTH + 1), size - WIDTH + 1, 1 if dense else max(1, size // 4)
        at = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
        return F.when(last >= 0, F.flatten(F.transform(at, lambda i: keys(F.slice(h, i + 1, n), size)))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(shingles, lambda x: F.xxhash64(x)), lambda h: F.concat(*(sized(h, s) for s in sizes)))


def templates(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """(license, t_shingles, keys) of the templates that have a shingle."""
    rows = spark.createDataFrame(list(texts.items()), "license string, text string").select("license", _words(F.col("text")).alias("w"))
    rows = rows.where(F.size("w") >= WIDTH).select("license", _shingles(F.col("w")).alias("s"))
    keys = F.array().cast("array<bigint>")
    for n in range(WIDTH, SIZES[0]):  # a template too short for a window is one
        keys = F.when(F.size("s") == n - WIDTH + 1, _bands(F.col("s"), True, (n,))).otherwise(keys)
    keys = F.when(F.size("s") > SIZES[0] - WIDTH, _bands(F.col("s"), True, SIZES)).otherwise(keys)
    return rows.select("license", F.array_distinct("s").alias("t_shingles"), F.array_distinct(keys).alias("keys"))


def candidates(held: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, s, license): for each row of ``held`` (doc_id, runs) the templates
    that share a band key with one of its windows."""
    lengths = {r["n"] + WIDTH - 1 for r in own.select(F.size("t_shingles").alias("n")).distinct().collect()}
    sizes = (*sorted(n for n in lengths if n < SIZES[0]), *SIZES)
    keys = F.flatten(F.transform("runs", lambda r: _bands(r, False, sizes)))
    keyed = held.select("doc_id", F.array_distinct(F.flatten("runs")).alias("s"), F.array_distinct(keys).alias("keys"))
    of = F.broadcast(own.select("license", F.explode("keys").alias("key")))
    return keyed.select("doc_id", "s", F.explode("keys").alias("key")).join(of, "key").select("doc_id", "s", "license").distinct()


def held_runs(docs: DataFrame, own: DataFrame) -> DataFrame:
    """(doc_id, runs): the shingles of each document's runs of template words;
    documents without a run have no row."""
    known = sorted(r["w"] for r in own.select(F.explode("t_shingles").alias("s")).select(F.explode(F.split("s", " ")).alias("w")).distinct().collect())

    def runs(words: Column) -> Column:
        marks = F.array_join(F.transform(words, lambda w: F.when(w.isin(known), "1").otherwise("0")), "")
        return F.transform(matches(marks, f"1{{{WIDTH},}}"), lambda r: _shingles(F.slice(words, r["start"] + 1, r["end"] - r["start"])))

    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(let(_words(F.col("text")), runs))).alias("runs"))
    # Spread over all tasks, as a stored table of few bytes has few files' worth of them.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(held.where(F.size("runs") > 0)).repartition(2 * parts)


def scan(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_shingles, n_found): the templates that each document
    holds, with the template's number of shingles and how many were found.

    Null, empty and short texts hold none and have no row. Repeated rows and
    rows with one doc_id give one row a template, with the most found. A null
    doc_id has its own rows. An empty table gives an empty result; columns
    other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    own = stored(templates(spark, TEMPLATES if texts is None else texts))
    near = candidates(held_runs(docs, own), own)
    sure = near.join(F.broadcast(own.select("license", "t_shingles")), "license")
    sure = sure.withColumn("n_found", F.size(F.array_intersect("s", "t_shingles")).cast("long")).withColumn("n_shingles", F.size("t_shingles").cast("long"))
    sure = sure.where(F.col("n_found") >= F.lit(CONTAINED) * F.col("n_shingles"))
    return sure.groupBy("doc_id", "license", "n_shingles").agg(F.max("n_found").alias("n_found"))


def oracle(texts: dict[str, str] | None = None) -> str:
    """DuckDB SQL for the same rows, by all shingles of all documents."""
    values = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in kv)) for kv in (TEMPLATES if texts is None else texts).items())
    words = f"regexp_extract_all(lower(coalesce(text, '')), '{WORD}')"
    cut = "[array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]"
    return f"""
    WITH t AS (SELECT license, unnest(list_distinct({cut})) AS s FROM (SELECT license, {words} AS w FROM (VALUES {values}) v(license, text)) WHERE len(w) >= 5),
    n AS (SELECT license, count(*) AS n_shingles FROM t GROUP BY license),
    d AS (SELECT doc_id, n, unnest(list_distinct({cut})) AS s FROM (SELECT doc_id, row_number() OVER () AS n, {words} AS w FROM documents) WHERE len(w) >= 5),
    f AS (SELECT doc_id, license, max(found) AS n_found FROM (SELECT doc_id, n, license, count(*) AS found FROM d JOIN t USING (s) GROUP BY doc_id, n, license) GROUP BY doc_id, license)
    SELECT doc_id, license, n_shingles, n_found FROM f JOIN n USING (license) WHERE n_found >= 0.8 * n_shingles"""
