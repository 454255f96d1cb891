"""License scans by diagonal voting.

Documents and license templates are cut into words.  Every window of three words
of a document is hashed, and all of them are joined to the template places with the same hash;
each match votes for the diagonal document place minus template place.  Votes are counted
by diagonal, and neighbouring diagonals merged: to one span while they lie at most ``GAP`` of the
template's length apart (inserted or left out words).  A span with enough votes is verified by aligning its
matches with the template: the best chain in the order of both must cover ``COVERED`` of the template.
Licenses quote each other, so of chains that share half of their place the longest gives the label.
Phrases (short templates) need all their votes on one diagonal, which is the same as their words standing
consecutively.

Scale: one pass over the texts; windows are joined where they are made, to a constant of
this module that is broadcast, and nothing but votes goes further.  Hashes have 62 bits, so
that equal ones are taken for equal words.  Votes are counted in their task before they are shuffled.

Edge cases: null and empty texts have no words, places or labels and score 0;
overlapping places all count; repeated rows each get a row; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import kernels as K
from quillon.llm.shared import cut

#: Phrases whose every place counts, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The paragraphs of public licenses and of the notices they ask for, in the scanner's words, with their labels.
TEMPLATES = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    ),
    "boost": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
        "distributed under the boost software license version 1 0",
    ),
    "gpl-2": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ),
    "gpl-3": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this work is licensed under the gnu general public license version 3",
    ),
    "lgpl": (
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ),
    "agpl-3": ("this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",),
    "mpl-2": (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
    ),
    "cc-by-nc": (
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
        "creative commons attribution noncommercial 4 0 international",
        "licensed under cc by nc 4 0",
    ),
    "cc-by-sa": (
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
        "creative commons attribution sharealike 4 0 international",
        "licensed under cc by sa 4 0",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
}

GRAM, DRIFT, COVERED, GAP = 3, 2, 0.7, 0.4
#: Stands before the windows of every document, and is a template of its own, so that each document has a row.
_START = -1

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: What is no word byte once A-Z is lower-case: \x00-\x2F, \x3A-\x60, \x7B-\x7F.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True


def _hashed(part: K.Slice) -> tuple[K.Words, np.ndarray, np.ndarray]:
    """Words, hashes of the word windows, and the places where a window lies in one row."""
    w = K.words(part, _SEPARATOR, _FOLD)
    g = K.grams(w.hash, GRAM)
    return w, g, np.flatnonzero(w.row[: len(g)] == w.row[GRAM - 1 : GRAM - 1 + len(g)]) if len(g) else np.zeros(0, int)


def template_rows() -> list[tuple[int, bool, str, int, int, int]]:
    """(template, phrase, label, windows, place, hash) of every template place."""
    found, every = [], [(p, True, x) for p, x in PHRASES.items()] + [(t, False, x) for x, ts in TEMPLATES.items() for t in ts]
    for n, (text, phrase, label) in enumerate(every):
        (part,) = K.slices(pa.array([text]))
        _, g, at = _hashed(part)
        found += [(n, phrase, label, len(at), int(i), int(g[i].astype(np.int64))) for i in at]
    return found


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and the hashes of all windows in order, behind the start mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.slices(batch.column(1)):
                w, g, at = _hashed(part)
                ends = np.searchsorted(w.row[at], np.arange(len(part) + 1))
                hashes = np.insert(g[at].astype(np.int64), ends[:-1], _START)
                offsets = (ends + np.arange(len(part) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), pa.array(np.diff(w.bounds), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashes))], names=["doc_id", "n_words", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, hashes array<long>")


def chained(votes: list[tuple[int, int]], windows: int) -> tuple[int, int, int]:
    """The most places of a template, in order, that a chain of votes (place, t_place) covers, and its first and last place.

    From a vote to the next the diagonal may move by ``GAP`` of the template's length (inserted or left out
    words), and a chain spans at most twice the template.
    """
    gap = max(DRIFT, int(np.ceil(GAP * windows)))
    ends: list[tuple[int, int, int, int]] = []  # place, t_place, votes so far, first place
    best, low = (0, 0, 0), 0
    for place, t in sorted(set(votes)):
        while low < len(ends) and ends[low][0] < place - windows - gap:
            low += 1
        n, first = 1, place
        for x, u, m, start in ends[low:]:
            if x < place and u < t and abs((place - t) - (x - u)) <= gap and place - start <= 2 * windows and (m + 1, start) > (n, first):
                n, first = m + 1, start
        ends.append((place, t, n, first))
        best = max(best, (n, first, place), key=lambda x: x[0])
    return best


def verified(spans: DataFrame) -> DataFrame:
    """(row, label, windows, n, first, last) of the best chain of matches of each of spans (row, label, windows, places, t_places)."""
    names = ["n", "first", "last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)
            best = [chained(list(zip(places, t_places, strict=True)), n) for n, places, t_places in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([x[i] for x in best], pa.int64()) for i in range(3))], names=["row", "label", "windows", *names])

    return spans.select("row", "label", "windows", "places", "t_places").mapInArrow(run, "row long, label string, windows int, n long, first long, last long")


def longest(spans: DataFrame) -> DataFrame:
    """(row, label) of the verified spans that no longer chain shares half of the place of; as long ones both stay."""
    lists = spans.groupBy("row").agg(F.collect_list(F.struct("label", "n", "first", "last")).alias("all"))

    def beaten(x: Column) -> Column:
        shared = lambda y: F.least(x["last"], y["last"]) - F.greatest(x["first"], y["first"]) + 1
        return F.exists("all", lambda y: (y["n"] > x["n"]) & (2 * shared(y) >= x["last"] - x["first"] + 1))

    return lists.select("row", F.explode(F.filter("all", lambda x: ~beaten(x))).alias("x")).select("row", F.col("x.label").alias("label"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: places of the phrases, labels, and the largest share of a template that a span covers."""
    spark = docs.sparkSession
    templates = spark.createDataFrame([(-1, False, None, 0, 0, _START), *template_rows()], "template int, phrase boolean, label string, windows int, t_place int, hash long")
    # a row's identity, so that repeated ids stay rows of their own
    rows = windows(docs).withColumn("row", F.monotonically_increasing_id())
    every = rows.select("row", "doc_id", "n_words", F.posexplode("hashes").alias("place", "hash")).withColumn("place", F.col("place") - 1)
    votes = every.join(F.broadcast(templates), "hash")
    votes = cut(votes.select("row", "doc_id", "n_words", "template", "phrase", "label", "windows", "place", "t_place"), "votes")
    of = ["row", "template", "phrase", "label", "windows"]
    voted = votes.filter("template >= 0").groupBy(*of, (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.count("*").alias("n"), F.collect_list("place").alias("places"))
    voted = cut(voted, "diagonals")

    # neighbouring diagonals of a template are one span
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.greatest(F.lit(DRIFT), F.ceil(GAP * F.col("windows"))) < F.col("diagonal") - F.lag("diagonal").over(by)
    held = voted.filter("not phrase").withColumn("new", F.when(apart, 1).otherwise(0)).withColumn("span", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    t_places = F.transform("places", lambda x: (x - F.col("diagonal")).cast("int"))
    held = held.groupBy("row", "template", "label", "windows", "span").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list(t_places)).alias("t_places"))
    spans = verified(held.filter(F.size(F.array_distinct("t_places")) >= COVERED * F.col("windows")))
    spans = cut(spans.filter(F.col("n") >= COVERED * F.col("windows")), "spans")

    share, no_place = F.col("n") / F.col("windows"), F.lit(None).cast("long").alias("diagonal")
    found = voted.select("row", "label", "phrase", "diagonal", share.alias("share"))
    # a span's label counts where it isn't beaten, its share in any case
    found = found.unionByName(spans.select("row", F.lit(None).cast("string").alias("label"), F.lit(False).alias("phrase"), no_place, share.alias("share")))
    found = found.unionByName(longest(spans).select("row", "label", F.lit(False).alias("phrase"), no_place, F.lit(None).cast("double").alias("share")))
    base, covered = F.col("phrase") & (F.col("share") == 1), ~F.col("phrase") & F.col("diagonal").isNull()
    found = found.groupBy("row").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set(F.when(base | covered, F.col("label"))).alias("labels"),
        F.max(F.when(base, F.lit(1.0)).when(~F.col("phrase"), F.col("share"))).alias("score"),
    )
    text = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    found = votes.filter("template < 0").select("row", "doc_id", "n_words").join(found, "row", "left")
    return found.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), text("base_labels"), text("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
