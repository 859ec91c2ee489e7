"""License scan by diagonal voting.

Every word k-gram of every text is hashed and joined with the (gram, place)
table of the templates, a fixed list in this module and so a bounded
broadcast. A hit of text place p and template place t votes for the diagonal
p - t of its text and template. A run of a template's words stands on one
diagonal; words put in or left out shift it, so from each diagonal on those at
most half a template's length further are merged, and the best such band is
verified: enough of the template's different places must be hit in it. A band's width
is bounded, so its span is at most MAX_STRETCH times the template, and words that
follow a notice cannot hide it. The score is the best share of a band, among
templates of which the text holds enough hits in all.

A base phrase must be hit in full on one diagonal (its grams are k words of
k + n places, so full votes mean equal words up to a 64-bit hash).

Hits are few beside the words read; they are grouped by text, so no frequent
source, phrase or copy gathers in one task beyond the hits of one text. Each
text also sends one marker with its number of words through the join, so
texts without hits have their row. Null texts are empty. Rows are documents:
repeated rows or ids are scanned each. An empty table gives no row; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, byte_class, gram_hashes, map_arrow, text_slices, word_bounds, word_hashes

K = 2             # words of a gram
MIN_SHARE = 0.6   # of a template's places that a span must hit
MAX_STRETCH = 1.5  # span length over template length

WORD_BYTES = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])

# The base phrases.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
# Opening words of public license notices.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc", "this work is licensed under a creative commons attribution"),
)
# Whole public license texts, without titles and copyright lines.
WHOLE_TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction including without "
            "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the "
            "software and to permit persons to whom the software is furnished to do so subject to the following "
            "conditions the above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the software the software is provided as is without warranty of any kind express or "
            "implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
            "noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
            "liability whether in an action of contract tort or otherwise arising from out of or in connection with the "
            "software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
            "granted provided that the above copyright notice and this permission notice appear in all copies the software "
            "is provided as is and the author disclaims all warranties with regard to this software including all implied "
            "warranties of merchantability and fitness in no event shall the author be liable for any special direct "
            "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether "
            "in an action of contract negligence or other tortious action arising out of or in connection with the use or "
            "performance of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the "
            "following conditions are met 1 redistributions of source code must retain the above copyright notice this list "
            "of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright "
            "notice this list of conditions and the following disclaimer in the documentation and or other materials "
            "provided with the distribution this software is provided by the copyright holders and contributors as is and "
            "any express or implied warranties including but not limited to the implied warranties of merchantability and "
            "fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be "
            "liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
            "to procurement of substitute goods or services loss of use data or profits or business interruption however "
            "caused and on any theory of liability whether in contract strict liability or tort including negligence or "
            "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
               "the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required "
               "by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
               "basis without warranties or conditions of any kind either express or implied see the license for the "
               "specific language governing permissions and limitations under the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version 3 of the license or at your option "
            "any later version this program is distributed in the hope that it will be useful but without any warranty "
            "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general "
            "public license for more details you should have received a copy of the gnu general public license along with "
            "this program if not see http www gnu org licenses"),
)
TEMPLATES = PHRASES + NOTICES + WHOLE_TEXTS


def most_drift(size: int) -> int:
    """Diagonals that a band of a template of ``size`` grams may span."""
    return int((MAX_STRETCH - 1) * size)

_MARK = np.uint64(0x4D41524B)   # the gram that markers join by
_GRAMS = "row long, doc_id long, place long, gram long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text a marker (place = number of words) and every gram with its place."""
    row = TaskContext.get().partitionId() << 36
    is_word = byte_class(WORD_BYTES)
    for batch in batches:
        ids = batch.column("doc_id")
        for first, end, data, cut in text_slices(batch.column("text"), SLICE_BYTES):
            starts, ends, words = word_bounds(data, cut, is_word)
            counts = np.diff(words)
            grams = gram_hashes(word_hashes(data, starts, ends), K)
            grams = np.where(grams == _MARK, _MARK + np.uint64(1), grams)
            text_of = np.repeat(np.arange(end - first), counts)[: len(grams)]
            place = np.arange(len(grams)) - words[text_of]
            whole = place + K <= counts[text_of]  # not over the end of its text
            rows = row + np.arange(end - first)
            row += end - first
            n = int(whole.sum())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([rows, rows[text_of[whole]]])),
                pa.concat_arrays([ids.slice(first, end - first), pa.nulls(n, pa.int64())]),
                pa.array(np.concatenate([counts, place[whole]])),
                pa.array(np.concatenate([np.full(end - first, _signed(_MARK.reshape(1))[0]), _signed(grams[whole])]))],
                names=["row", "doc_id", "place", "gram"])


def template_grams(spark: SparkSession) -> DataFrame:
    """gram, template, label, base, grams in all, place there: a few hundred rows."""
    is_word = byte_class(WORD_BYTES)
    rows = [(int(_signed(_MARK.reshape(1))[0]), -1, "", False, 0, 0)]
    for number, (label, phrase) in enumerate(TEMPLATES):
        data = np.frombuffer(phrase.encode(), np.uint8)
        starts, ends, _ = word_bounds(data, np.array([0, len(data)]), is_word)
        grams = _signed(gram_hashes(word_hashes(data, starts, ends), K)).tolist()
        rows += [(g, number, label, number < len(PHRASES), len(grams), i) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, template int, label string, base boolean, size int, at int")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: words, base places, labels of both kinds, best share of a template."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    grams = map_arrow(plain, _grams, _GRAMS)
    hits = grams.join(F.broadcast(template_grams(docs.sparkSession)), "gram").repartition("row")
    # One row per text, template and diagonal (markers: one per text).
    voted = (hits.groupBy("row", "template", "label", "base", "size", (F.col("place") - F.col("at")).alias("diagonal"))
             .agg(F.count("*").alias("votes"), F.max("doc_id").alias("doc_id"), F.max("place").alias("last"),
                  F.min("place").alias("first"), F.collect_set("at").alias("ats")))
    # From each diagonal of a notice, those up to its greatest drift on; a base phrase's diagonals stay apart.
    widest = max(most_drift(len(phrase.split()) - 1) for _, phrase in NOTICES + WHOLE_TEXTS)
    on = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, widest)
    notice = ~F.col("base") & (F.col("template") >= 0)
    # Most texts share a few common words with a template: bands are only made where its hits could suffice at all.
    votes = F.sum("votes").over(Window.partitionBy("row", "template"))
    voted = voted.withColumn("all_votes", votes).filter(~notice | (F.col("all_votes") >= MIN_SHARE * F.col("size")))
    band = F.collect_list(F.when(notice, F.struct("diagonal", "ats"))).over(on)
    voted = voted.withColumn("band", band)
    reach = F.col("diagonal") + F.floor((MAX_STRETCH - 1) * F.col("size"))
    merged = F.array_distinct(F.flatten(F.transform(F.filter("band", lambda x: x.diagonal <= reach), lambda x: x.ats)))
    spans = voted.withColumn("hit", F.when(notice, F.size(merged)).otherwise(F.size("ats"))).withColumn(
        "start", F.col("diagonal"))
    share = F.col("hit") / F.greatest(F.col("size"), F.lit(1))
    full = F.col("base") & (F.col("hit") == F.col("size"))
    found = notice & (share >= MIN_SHARE)
    mark = F.col("template") == -1

    def labels(of: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(of, F.col("label")))), ",")

    return (spans.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max(F.when(mark, F.col("last"))).alias("n_words"),
        F.count_if(full).alias("n_base"),
        F.min(F.when(full, F.col("start"))).alias("first_word"),
        F.max(F.when(full, F.col("start"))).alias("last_word"),
        labels(full).alias("base_labels"),
        labels(full | found).alias("labels"),
        F.coalesce(F.max(F.when(full, F.lit(1.0)).when(notice, share)), F.lit(0.0)).alias("score"))
        .drop("row"))


_ROWS = ", ".join(f"({number}, '{label}', {str(number < len(PHRASES)).lower()}, '{phrase}')"
                  for number, (label, phrase) in enumerate(TEMPLATES))
SQL = rf"""
WITH templates AS (
  SELECT t, label, base, w, len(w) - 1 AS size FROM (
    SELECT t, label, base, string_split(phrase, ' ') AS w FROM (VALUES {_ROWS}) v(t, label, base, phrase))),
grams AS (
  SELECT t, label, base, size, i - 1 AS pos, w[i] AS x, w[i + 1] AS y
  FROM (SELECT *, unnest(range(1, size + 1)) AS i FROM templates)),
d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
p AS (SELECT rid, i - 1 AS place, w[i] AS x, w[i + 1] AS y
      FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
votes AS (
  SELECT rid, t, label, base, size, place - pos AS diagonal, min(place) AS low, max(place) AS high, list(pos) AS ats
  FROM p JOIN grams USING (x, y) GROUP BY ALL),
bands AS (
  SELECT a.rid, a.t, a.diagonal, len(list_distinct(flatten(list(b.ats)))) AS hit
  FROM votes a JOIN votes b ON a.rid = b.rid AND a.t = b.t
    AND b.diagonal BETWEEN a.diagonal AND a.diagonal + floor({MAX_STRETCH - 1} * a.size)
  JOIN (SELECT rid, t FROM votes GROUP BY rid, t, size HAVING sum(len(ats)) >= {MIN_SHARE} * size) enough
    ON a.rid = enough.rid AND a.t = enough.t
  WHERE NOT a.base GROUP BY a.rid, a.t, a.diagonal),
judged AS (
  SELECT rid, label, diagonal AS start, len(ats) = size AS whole, NULL::DOUBLE AS share, false AS found
  FROM votes WHERE base
  UNION ALL
  SELECT rid, label, diagonal, false, hit / size::DOUBLE, hit / size::DOUBLE >= {MIN_SHARE}
  FROM bands JOIN (SELECT DISTINCT t, label, size FROM templates) USING (t))
SELECT d.doc_id, CAST(len(any_value(d.w)) AS BIGINT) AS n_words, count(*) FILTER (whole) AS n_base,
       min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
       array_to_string(coalesce(list_sort(list(DISTINCT label) FILTER (whole)), []), ',') AS base_labels,
       array_to_string(coalesce(list_sort(list(DISTINCT label) FILTER (whole OR found)), []), ',') AS labels,
       coalesce(max(CASE WHEN whole THEN 1.0::DOUBLE ELSE share END), 0.0::DOUBLE) AS score
FROM d LEFT JOIN judged USING (rid) GROUP BY d.rid, d.doc_id
"""
