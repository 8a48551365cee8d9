"""Licence scans by a positional rare-token index (DataFrame operations only).

A fixed table of licence notices is indexed by word position.  Inverse document
frequencies of the notices' words are counted over the whole corpus; each notice is
looked up by its rarest words.  A file's rare words and the notices' postings give
relative positions (offset = place in the file - place in the notice); where enough
rare words agree on one offset, the notice is a candidate, and it counts when all
words of its mandatory key phrase stand at that offset and enough of the notice does.

Work: one scan that tokenises every whole text and keeps only the places of licence words.
Only the places of rare words are looked up in the index (a table of fixed size); the other
words are read again for the files that have a candidate, at the candidate's own places.

Edge cases: a null or empty text has zero words and no label; repeated rows and rows
that share a doc_id are scanned separately; an empty table gives an empty result;
columns other than the id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveylens.llm.common import LOWER, UPPER, ascii_lower, load, materialise

# Phrases and labels of the base scan.
BASE_PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]

# Fixed values: (label, notice, mandatory key phrase inside the notice).
NOTICES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files", "hereby granted free of charge"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3",
     "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license",
     "lesser general public license"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted", "permission to use copy modify"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0",
     "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
    # whole paragraphs of the licence texts
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files the software to deal in the software "
            "without restriction including without limitation the rights to use copy modify merge "
            "publish distribute sublicense and or sell copies of the software and to permit persons "
            "to whom the software is furnished to do so subject to the following conditions the "
            "above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the software", "deal in the software without restriction"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file "
               "except in compliance with the license you may obtain a copy of the license at http "
               "www apache org licenses license 2 0 unless required by applicable law or agreed to "
               "in writing software distributed under the license is distributed on an as is basis "
               "without warranties or conditions of any kind either express or implied see the "
               "license for the specific language governing permissions and limitations under the "
               "license", "unless required by applicable law or agreed to in writing"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms "
            "of the gnu general public license as published by the free software foundation either "
            "version 3 of the license or at your option any later version this program is "
            "distributed in the hope that it will be useful but without any warranty without even "
            "the implied warranty of merchantability or fitness for a particular purpose see the gnu "
            "general public license for more details", "gnu general public license as published"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms "
             "of the gnu lesser general public license as published by the free software foundation "
             "either version 2 1 of the license or at your option any later version this library is "
             "distributed in the hope that it will be useful but without any warranty without even "
             "the implied warranty of merchantability or fitness for a particular purpose see the "
             "gnu lesser general public license for more details",
     "gnu lesser general public license as published"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met redistributions of source code "
            "must retain the above copyright notice this list of conditions and the following "
            "disclaimer redistributions in binary form must reproduce the above copyright notice "
            "this list of conditions and the following disclaimer in the documentation and or other "
            "materials provided with the distribution", "redistributions of source code must retain"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted provided that the above copyright notice and this "
            "permission notice appear in all copies", "permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a "
            "copy of the mpl was not distributed with this file you can obtain one at https mozilla "
            "org mpl 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is "
                  "free to copy modify publish use compile sell or distribute this software either "
                  "in source code form or as a compiled binary for any purpose commercial or non "
                  "commercial and by any means", "anyone is free to copy modify publish use compile"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including "
             "commercial applications and to alter it and redistribute it freely subject to the "
             "following restrictions the origin of this software must not be misrepresented",
     "origin of this software must not be misrepresented"),
]

# Function words, which are never indexed.
FUNCTION_WORDS = ("a and any are by can following for in into is it of or that the this to under "
                  "with without you be use met").split()

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # as words are cut before lower-casing


def _key_start(notice: list[str], key: list[str]) -> int:
    return next(i for i in range(len(notice)) if notice[i:i + len(key)] == key)


def postings() -> list[tuple[int, str, int, int, str, int, int]]:
    """(notice, label, indexed words of it, indexed words of its key, word, place, in key)."""
    rows = []
    for n, (label, notice, key) in enumerate(NOTICES):
        words, key_words = notice.split(), key.split()
        at = _key_start(words, key_words)
        kept = [(w, i, int(at <= i < at + len(key_words)))
                for i, w in enumerate(words) if w not in FUNCTION_WORDS]
        rows += [(n, label, len(kept), sum(k for _, _, k in kept), w, i, k) for w, i, k in kept]
    return rows


def vocabulary() -> list[str]:
    return sorted({r[4] for r in postings()} | {w for _, p in BASE_PHRASES for w in p.split()})


def words_of(text: Column) -> Column:
    """Words of a whole text, not yet lower-cased (A-Z are word characters either way)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def licence_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """uid, id, n_words, places: array of (pos, word) of every licence word in the text."""
    vocab = vocabulary()
    cut = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"),
                      words_of(F.col(text_col)).alias("words"))
    near = F.filter(F.transform("words", lambda w, i: F.when(
        F.lower(w).isin(vocab), F.struct(i.cast("long").alias("pos"), ascii_lower(w).alias("word")))),
        lambda m: m.isNotNull() & m["word"].isin(vocab))
    return cut.select("uid", "id", F.size("words").cast("long").alias("n_words"), near.alias("places"))


def rare_places(places: DataFrame, rare: list[str]) -> DataFrame:
    """uid, pos, word of the places of ``rare`` words: all that the index is asked for."""
    kept = F.filter("places", lambda m: m["word"].isin(rare))
    return places.filter(F.size(kept) > 0).select("uid", F.explode(kept).alias("m")) \
        .select("uid", "m.pos", "m.word")


def verified(places: DataFrame, candidates: DataFrame, post: DataFrame, min_coverage: float) -> DataFrame:
    """The candidates (uid, notice, offset) whose key phrase stands whole at the offset, with at
    least ``min_coverage`` of the notice's indexed words: uid, notice, label, size, found."""
    # only the candidates' own files are opened again, and only at the places a notice names
    held = (places.join(candidates.select("uid").distinct(), "uid", "left_semi")
            .select("uid", F.explode("places").alias("m")).select("uid", "m.pos", "m.word"))
    wanted = candidates.join(F.broadcast(post), "notice").select(
        "uid", "notice", "offset", "label", "size", "key_size", "in_key", "word",
        (F.col("offset") + F.col("place")).alias("pos"))
    return (wanted.join(held, ["uid", "pos", "word"])
            .groupBy("uid", "notice", "label", "size", "key_size", "offset")
            .agg(F.count(F.lit(1)).alias("found"), F.sum("in_key").alias("found_key"))
            .filter((F.col("found_key") == F.col("key_size"))
                    & (F.col("found") >= F.col("size") * F.lit(min_coverage))))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rare_words: int = 3, min_rare: int = 2, min_coverage: float = 0.6) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_notices.

    The ``rare_words`` words of highest IDF, of those that the corpus has, index each notice;
    ``min_rare`` of them must agree on a relative position; ``min_coverage`` of a notice's
    indexed words must stand there.  score is the best coverage of a verified notice, 0.5 at
    least when a base phrase was found, else 0.
    """
    spark = docs.sparkSession
    places = materialise(licence_places(docs, id_col, text_col), "licence-places")
    # document frequency of every licence word over the whole corpus (bounded by the vocabulary)
    df = {r["word"]: r["n"] for r in places.filter(F.size("places") > 0)
          .select(F.explode(F.array_distinct(F.transform("places", lambda m: m["word"]))).alias("word"))
          .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, index = postings(), []
    for n in range(len(NOTICES)):
        rare = sorted({r[4] for r in rows if r[0] == n and df.get(r[4])}, key=lambda w: (df[w], w))[:rare_words]
        index += [(n, r[4], r[5], min(min_rare, len(rare))) for r in rows if r[0] == n and r[4] in rare]
    post = spark.createDataFrame(rows, "notice int, label string, size int, key_size int, word string, "
                                       "place int, in_key int")
    look_up = spark.createDataFrame(index, "notice int, word string, place int, need int")
    candidates = (rare_places(places, sorted({r[1] for r in index})).join(F.broadcast(look_up), "word")
                  .groupBy("uid", "notice", "need", (F.col("pos") - F.col("place")).alias("offset"))
                  .agg(F.countDistinct("word").alias("found_rare"))
                  .filter(F.col("found_rare") >= F.col("need")).select("uid", "notice", "offset"))
    aligned = verified(places, materialise(candidates, "licence-candidates"), post, min_coverage)
    notices = aligned.groupBy("uid").agg(
        F.collect_set("label").alias("notice_labels"), F.count(F.lit(1)).alias("n_notices"),
        F.max(F.col("found") / F.col("size")).alias("coverage"))
    # phrases whose words stand consecutively, counted per phrase
    rows = [(p, label, len(text.split()), w, i) for p, (label, text) in enumerate(BASE_PHRASES)
            for i, w in enumerate(text.split())]
    phrases = spark.createDataFrame(rows, "phrase int, label string, size int, word string, place int")
    base = (rare_places(places, sorted({r[3] for r in rows})).join(F.broadcast(phrases), "word")
            .groupBy("uid", "phrase", "label", "size", (F.col("pos") - F.col("place")).alias("start"))
            .agg(F.count(F.lit(1)).alias("found")).filter("found = size")
            .groupBy("uid").agg(F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"),
                                F.max("start").alias("last_word"), F.collect_set("label").alias("own")))
    empty = F.array().cast("array<string>")
    own, more = F.coalesce("own", empty), F.coalesce("notice_labels", empty)
    return (places.select("uid", "id", "n_words").join(base, "uid", "left").join(notices, "uid", "left")
            .select(F.col("id").alias(id_col), "n_words",
                    F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    F.col("first_word").cast("long"), F.col("last_word").cast("long"),
                    F.array_join(F.array_sort(own), ",").alias("base_labels"),
                    F.array_join(F.array_sort(F.array_union(own, more)), ",").alias("labels"),
                    F.greatest(F.coalesce("coverage", F.lit(0.0)),
                               F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
                    F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices")))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents", "doc_id", "text"))


def oracle() -> str:
    """The same scan in DuckDB SQL."""
    quoted = ", ".join(f"('{w}')" for w in vocabulary())
    post = ", ".join(f"({n}, '{label}', {size}, {key}, '{w}', {i}, {k})"
                     for n, label, size, key, w, i, k in postings())
    phrases = ", ".join(f"({p}, '{label}', {len(text.split())}, '{w}', {i})"
                        for p, (label, text) in enumerate(BASE_PHRASES) for i, w in enumerate(text.split()))
    return rf"""
WITH vocab(word) AS (VALUES {quoted}),
post(notice, label, size, key_size, word, place, in_key) AS (VALUES {post}),
phrases(phrase, label, size, word, place) AS (VALUES {phrases}),
cut AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
every AS (SELECT uid, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM cut),
hits AS (SELECT uid, pos, word FROM every JOIN vocab USING (word)),
df AS (SELECT v.word, count(DISTINCT uid) AS n FROM vocab v LEFT JOIN hits h ON h.word = v.word GROUP BY 1),
ranked AS (
  SELECT notice, word, row_number() OVER (PARTITION BY notice ORDER BY n, word) AS k
  FROM (SELECT DISTINCT notice, p.word, n FROM post p JOIN df ON df.word = p.word WHERE n > 0)),
needs AS (SELECT notice, least(2, count(*)) AS need FROM ranked WHERE k <= 3 GROUP BY notice),
idx AS (
  SELECT p.*, CASE WHEN r.k <= 3 THEN 1 ELSE 0 END AS rare, need
  FROM post p JOIN ranked r ON r.notice = p.notice AND r.word = p.word JOIN needs d ON d.notice = p.notice),
aligned AS (
  SELECT uid, notice, label, size, pos - place AS off, count(*) AS found
  FROM hits JOIN idx USING (word) GROUP BY uid, notice, label, size, key_size, need, pos - place
  HAVING count(DISTINCT CASE WHEN rare = 1 THEN word END) >= need AND sum(in_key) = key_size
     AND count(*) >= size * CAST(0.6 AS DOUBLE)),
notices AS (
  SELECT uid, list(DISTINCT label) AS more, count(*) AS n_notices,
    max(CAST(found AS DOUBLE) / size) AS coverage FROM aligned GROUP BY uid),
places AS (
  SELECT uid, phrase, label, pos - place AS start
  FROM hits JOIN phrases USING (word) GROUP BY uid, phrase, label, size, pos - place
  HAVING count(*) = size),
base AS (
  SELECT uid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
    list(DISTINCT label) AS own FROM places GROUP BY uid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(own, CAST([] AS VARCHAR[]))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(own, CAST([] AS VARCHAR[])),
    coalesce(more, CAST([] AS VARCHAR[]))))), ',') AS labels,
  greatest(coalesce(coverage, CAST(0 AS DOUBLE)),
    CASE WHEN n_base > 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS score,
  coalesce(n_notices, 0) AS n_notices
FROM cut LEFT JOIN base USING (uid) LEFT JOIN notices USING (uid)
"""
