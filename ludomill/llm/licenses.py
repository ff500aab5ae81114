"""License scans over a positional index of rare licence words.  DataFrame functions only.

1. Words of a text are runs of letters, digits and characters outside ASCII, lower-cased in A-Z.  Those of the
   index (``PASSAGES``: words of ``LENGTH`` characters and more, and words of key phrases) are kept with their place.
2. A word weighs the number of binary digits of (documents div documents with the word).  Per text and passage the
   ``RARE`` heaviest different words that the text has are looked up.
3. Every place of such a word meets the word's postings; place minus posting is where the passage would begin.  Hits
   are put together by begin, in cells of 2 ``SLACK`` words that overlap by half, so a few words more or less in
   between do no harm.  What counts is the weight of the different words in a cell.
4. A passage is found in a cell with at least half the weight of its own ``RARE`` heaviest words, if each of its key
   phrases stands in full, word after word, in the same cell.

The plain phrases (``PLAIN``) count wherever their words stand consecutively.  ``score`` is 1 with a plain phrase, else
the best share of a passage's weight in a cell (0 to 1).

Texts are scanned in pieces of ``PIECE`` characters, cut between words, so that a very long text is several arrays, and
a hit is a row of its own from then on; no text and no list of hits is gathered.  A null text is empty.  Null and repeated
ids and repeated rows stay rows of their own, ordered by nothing.  Other columns are not read.  An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ludomill.session import settle

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LENGTH = 6
RARE = 8
SLACK = 4
PIECE = 1 << 20

# Plain phrases and their labels.
PLAIN = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Label, opening passage of the licence or of its notice, key phrases that must stand in it.
PASSAGES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
     " documentation files the software to deal in the software without restriction including without limitation the"
     " rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
     ["hereby granted", "associated documentation files"]),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"
     " unless required by applicable law or agreed to in writing software distributed under the license is distributed"
     " on an as is basis without warranties or conditions of any kind either express or implied",
     ["applicable law", "software distributed under"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
     " public license as published by the free software foundation",
     ["gnu general public license", "free software foundation"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser"
     " general public license as published by the free software foundation",
     ["gnu lesser general public license", "free software foundation"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero"
     " general public license as published by the free software foundation",
     ["gnu affero general public license", "free software foundation"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"
     " the following conditions are met redistributions of source code must retain the above copyright notice this list"
     " of conditions and the following disclaimer",
     ["binary forms", "permitted provided"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby"
     " granted provided that the above copyright notice and this permission notice appear in all copies",
     ["hereby granted provided", "permission notice appear"]),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
     " not distributed with this file you can obtain one at",
     ["mozilla public license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license",
     ["accompanying materials", "eclipse public license"]),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software"
     " and accompanying documentation covered by this license the software to use reproduce display distribute execute"
     " and transmit the software",
     ["accompanying documentation covered"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held"
     " liable for any damages arising from the use of this software permission is granted to anyone to use this software"
     " for any purpose including commercial applications",
     ["held liable", "commercial applications"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify"
     " publish use compile sell or distribute this software",
     ["unencumbered software released", "public domain"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
     ["neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution 4"]),
    ("cc-by", "licensed under cc by 4 0", ["licensed under cc by 4"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license",
     ["creative commons attribution sharealike"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["licensed under cc by sa"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
     ["creative commons attribution noncommercial"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["licensed under cc by nc"]),
]


def _phrases() -> list[tuple[int, str, int, int, int]]:
    """(phrase, word, place in the phrase, words of the phrase, passage or -1, begin in the passage): plain ones first."""
    out = []
    for text, _ in PLAIN:
        words = text.split()
        number = len({row[0] for row in out})
        out += [(number, w, k, len(words), -1, 0) for k, w in enumerate(words)]
    for passage, (_, text, keys) in enumerate(PASSAGES):
        whole = text.split()
        for key in keys:
            words = key.split()
            begin = next(i for i in range(len(whole)) if whole[i : i + len(words)] == words)
            number = len({row[0] for row in out})
            out += [(number, w, k, len(words), passage, begin) for k, w in enumerate(words)]
    return out


def _postings() -> list[tuple[int, str, int]]:
    """(passage, word, place) for the indexed words."""
    out = []
    for passage, (_, text, keys) in enumerate(PASSAGES):
        named = {w for key in keys for w in key.split()}
        out += [(passage, w, i) for i, w in enumerate(text.split()) if len(w) >= LENGTH or w in named]
    return out


def vocabulary() -> list[str]:
    return sorted({row[1] for row in _phrases()} | {row[1] for row in _postings()})


def _table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """One of the tables above; a few hundred rows whatever the input, so it may be broadcast."""
    return F.broadcast(spark.createDataFrame(rows, names))


def _pieces(text: Column) -> Column:
    """The text in pieces that end between words; a word longer than a piece is one."""
    cut = rf"[\s\S]{{1,{PIECE}}}(?!{WORD[:-1]})|{WORD}"
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))


def scan(docs: DataFrame) -> DataFrame:
    """row, doc_id, piece, n (words of the piece), hits (at, word) of every piece of every text."""
    known = vocabulary()
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    rows = rows.select("row", "doc_id", F.posexplode(_pieces(F.col("text"))).alias("piece", "part"))
    words = rows.select("row", "doc_id", "piece", F.regexp_extract_all("part", F.lit(WORD), F.lit(0)).alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(known), F.struct(i.alias("at"), w.alias("word"))))
    return words.select("row", "doc_id", "piece", F.size("words").cast("long").alias("n"), F.filter(hit, lambda h: h.isNotNull()).alias("hits"))


def placed(scanned: DataFrame) -> DataFrame:
    """row, at (place in the whole text), word."""
    # Only texts of several pieces need to know what came before.
    later = scanned.join(scanned.filter("piece > 0").select("row").distinct(), "row", "left_semi").select("row", "piece", "n")
    before = Window.partitionBy("row").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    begins = later.select("row", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    hits = scanned.filter(F.size("hits") > 0).join(begins, ["row", "piece"], "left")
    hits = hits.select("row", F.coalesce("begin", F.lit(0)).alias("begin"), F.inline("hits"))
    return hits.select("row", (F.col("begin") + F.col("at")).alias("at"), "word")


def _cells(begin: Column) -> Column:
    """Both cells a begin lies in: even and odd ones overlap by half."""
    cell = F.floor(begin / F.lit(SLACK))
    return F.explode(F.array(cell, cell - 1)).alias("cell")


def occurrences(hits: DataFrame) -> DataFrame:
    """row, phrase, passage, begin (in the passage), start: places where the words of a phrase stand consecutively."""
    phrases = _table(hits.sparkSession, _phrases(), "phrase int, word string, k int, m int, passage int, begin int")
    found = hits.join(phrases, "word").withColumn("start", F.col("at") - F.col("k"))
    found = found.groupBy("row", "phrase", "passage", "begin", "m", "start").agg(F.count(F.lit(1)).alias("n"))
    return found.filter("n = m").drop("n", "m")


def weighted(hits: DataFrame, n_texts: int) -> DataFrame:
    """passage, word, place, weight, need (the weight of the passage's heaviest words)."""
    spark = hits.sparkSession
    counts = {r.word: r.n for r in hits.select("row", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = {w: (n_texts // counts.get(w, 1)).bit_length() for w in vocabulary()}
    rows = []
    for passage, word, place in _postings():
        own = sorted({w for p, w, _ in _postings() if p == passage}, key=lambda w: (-weight[w], w))[:RARE]
        rows.append((passage, word, place, weight[word], sum(weight[w] for w in own)))
    return _table(spark, rows, "passage int, word string, place int, weight int, need int")


def passages_found(hits: DataFrame, phrases: DataFrame, n_texts: int) -> DataFrame:
    """row, passage, share (of the passage's weight, best cell), found."""
    index = weighted(hits, n_texts)
    words = hits.select("row", "word").distinct().join(index.select("passage", "word", "weight").distinct(), "word")
    rare = Window.partitionBy("row", "passage").orderBy(F.desc("weight"), "word")
    looked = words.withColumn("rank", F.row_number().over(rare)).filter(F.col("rank") <= RARE).select("row", "passage", "word")
    votes = hits.join(looked, ["row", "word"]).join(index, ["passage", "word"])
    votes = votes.select("row", "passage", _cells(F.col("at") - F.col("place")), "word", "weight", "need").distinct()
    keys = phrases.filter("passage >= 0").select("row", "passage", _cells(F.col("start") - F.col("begin")), "phrase").distinct()
    votes = votes.groupBy("row", "passage", "cell").agg(F.sum("weight").alias("weight"), F.max("need").alias("need"))
    keys = keys.groupBy("row", "passage", "cell").agg(F.count(F.lit(1)).alias("keys"))
    wanted = _table(hits.sparkSession, [(i, len(p[2])) for i, p in enumerate(PASSAGES)], "passage int, wanted int")
    cells = votes.join(keys, ["row", "passage", "cell"], "left").join(wanted, "passage")
    good = (2 * F.col("weight") >= F.col("need")) & (F.col("keys") == F.col("wanted"))
    part = F.least(F.lit(1.0), F.col("weight").cast("double") / F.col("need"))
    return cells.groupBy("row", "passage").agg(F.max(part).alias("share"), F.coalesce(F.max(good), F.lit(False)).alias("found"))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; see the top of this module."""
    spark = docs.sparkSession
    scanned = settle(scan(docs))
    rows = scanned.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_words"))
    hits = settle(placed(scanned))
    n_texts = rows.count()
    phrases = settle(occurrences(hits))
    plain = _table(spark, [(i, label) for i, (_, label) in enumerate(PLAIN)], "phrase int, label string")
    base = phrases.join(plain, "phrase").groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.collect_set("label").alias("plain_labels"),
    )
    named = _table(spark, [(i, p[0]) for i, p in enumerate(PASSAGES)], "passage int, label string")
    more = passages_found(hits, phrases, n_texts).join(named, "passage").groupBy("row").agg(
        F.max("share").alias("share"), F.collect_set(F.when(F.col("found"), F.col("label"))).alias("more_labels")
    )
    none = F.array().cast("array<string>")
    plain_labels, more_labels = F.coalesce("plain_labels", none), F.coalesce("more_labels", none)
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return rows.join(base, "row", "left").join(more, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.array_join(F.array_sort(plain_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(plain_labels, more_labels)), ",").alias("labels"),
        score.alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


#: The same in SQL.
SQL = rf"""
with phrases(phrase, word, k, m, passage, b) as (values {_values(_phrases())}),
postings(passage, word, place) as (values {_values(_postings())}),
plain(phrase, label) as (values {_values([(i, label) for i, (_, label) in enumerate(PLAIN)])}),
named(passage, label, wanted) as (values {_values([(i, p[0], len(p[2])) for i, p in enumerate(PASSAGES)])}),
d as (
  select row_number() over () as row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') as l
  from documents
), h as (
  select * from (select row, unnest(range(len(l))) as pos, unnest(l) as word from d)
  where word in (select word from phrases union all select word from postings)
), x as (select word, count(distinct row) as n from h group by word
), v as (
  select word, length(bin((select count(*) from d) // coalesce(n, 1))) as weight
  from (select word from postings union select word from phrases) left join x using (word)
), i as (select * from postings join v using (word)
), needs as (
  select passage, sum(weight) as need from (
    select *, row_number() over (partition by passage order by weight desc, word) as r
    from (select distinct passage, word, weight from i)
  ) where r <= {RARE} group by passage
), looked as (
  select row, passage, word from (
    select row, passage, word, row_number() over (partition by row, passage order by weight desc, word) as r
    from (select distinct row, passage, word, weight from h join i using (word))
  ) where r <= {RARE}
), o as (
  select row, phrase, passage, b, pos - k as start from h join phrases using (word)
  group by all having count(*) = any_value(m)
), votes as (
  select row, passage, cell, sum(weight) as weight from (
    select distinct row, passage, floor((pos - place) / {SLACK})::bigint - s as cell, word, weight
    from h join looked using (row, word) join i using (passage, word), (values (0), (1)) as t(s)
  ) group by all
), keys as (
  select row, passage, floor((start - b) / {SLACK})::bigint - s as cell, count(distinct phrase) as keys
  from o, (values (0), (1)) as t(s) where passage >= 0 group by all
), best as (
  select row, max(least(1.0::double, weight::double / need::double)) as share,
    list(distinct label) filter (where 2 * weight >= need and keys = wanted) as found
  from votes join needs using (passage) join named using (passage) left join keys using (row, passage, cell) group by row
), base as (
  select row, count(*) as n_base, min(start) as first_word, max(start) as last_word, list(distinct label) as plain
  from o join plain using (phrase) group by row
)
select doc_id, len(l)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word,
  last_word::bigint as last_word, coalesce(array_to_string(list_sort(plain), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(plain, []), coalesce(found, [])))), ','), '') as labels,
  case when n_base > 0 then 1.0::double else coalesce(share, 0.0)::double end as score
from d left join base using (row) left join best using (row)
"""
