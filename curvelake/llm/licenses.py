"""License scans by diagonal voting, in DataFrame operations only.

All rolling k-word hashes of every text are joined to the positions of license templates.  A match votes
for the diagonal (text position minus template position); votes are summed per text, template and diagonal
before they are shuffled; neighbouring diagonals, which inserted or dropped words cause, are merged where
text and template go on in the same direction; and a merged span is verified: the words of each vote were
compared, the distinct template positions that voted must cover enough of the template, and the span may not
be much longer than what it covers.  A passage that a text repeats thus counts once.

Phrases are found in the same pass, word by word, and add their label wherever they stand.

The templates are a parameter of at most ``MOST`` words in all, so their table may be broadcast.
Cases: null and empty texts have no words, no labels and score 0; repeated rows each get their row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import native as N
from .scratch import Scratch

MOST = 100_000

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices and opening or key passages of public licenses, with labels of their own.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


def _template_words(text: str) -> list[str]:
    kept = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in kept).split()


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, k: int = 3, slack: int = 4, coverage: float = 0.6, density: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, text_key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``slack`` merges diagonals that lie so many words apart at most; ``coverage`` is the least share of a
    template's k-grams, ``density`` the least share of a span's places that vote.  spans lists (label, first,
    last word, coverage) of the verified ones; score is the largest coverage, 1 where a phrase stands.
    """
    spark = docs.sparkSession
    cut = [_template_words(t) for _, t in templates]
    if sum(map(len, cut)) > MOST:
        raise ValueError(f"templates of more than {MOST} words: split them over several scans")
    grams = [(" ".join(w[i : i + k]), t, i) for t, w in enumerate(cut) for i in range(len(w) - k + 1)]
    table = spark.createDataFrame(grams, "gram string, template int, tpos int").groupBy("gram").agg(F.collect_list(F.struct("template", "tpos")).alias("places"))
    table = table.withColumn("w", F.split("gram", " ")).select(N.gram(F.col("w"), 0, k).alias("h"), F.col("w").alias("gram_words"), "places")
    names = spark.createDataFrame([(t, label, len(w) - k + 1) for t, ((label, _), w) in enumerate(zip(templates, cut, strict=True)) if len(w) >= k], "template int, label string, size int")

    at = N.positions(docs, id_col, text_col).withColumn("h", F.when(F.col("pos") > 0, N.gram(F.col("w"), F.col("pos"), k)).otherwise(F.lit(N.HEAD)))
    phrase = F.lit(None).cast("string")
    for text, label in phrases.items():
        stands = F.lit(True)
        for j, word in enumerate(text.split()):
            stands = stands & (F.coalesce(F.get("w", F.col("pos") + j), F.lit("")) == word)
        phrase = F.when(stands & (F.col("pos") > 0), F.lit(label)).otherwise(phrase)
    joined = at.withColumn("phrase", phrase).join(F.broadcast(table), "h", "left")
    places = F.when(F.expr(f"slice(w, pos + 1, {k}) = gram_words"), F.col("places"))
    kept = joined.where("pos = 0 or phrase is not null or gram_words is not null").select("doc_id", "text_key", "n_words", "pos", "phrase", F.posexplode_outer(places).alias("nth", "place"))
    base = F.when(F.coalesce("nth", F.lit(0)) == 0, F.col("phrase"))
    flags = [F.max(F.when(base == label, 1).otherwise(0)).alias(f"base_{i}") for i, label in enumerate(sorted(set(phrases.values())))]
    first = F.when(base.isNotNull(), F.col("pos") - 1)
    voted = kept.withColumn("template", F.col("place.template")).withColumn("diagonal", F.col("pos") - F.col("place.tpos"))
    # three readers follow: votes are few, so they are written instead of scanning all texts again
    votes = Scratch(spark, "licenses").write("votes", voted.groupBy("doc_id", "text_key", "template", "diagonal").agg(F.max("n_words").alias("n_words"), F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).alias("copies"), F.count(base).alias("n_base"), F.min(first).alias("first_word"), F.max(first).alias("last_word"), *flags, F.collect_set("place.tpos").alias("tset"), F.min("pos").alias("lo"), F.max("pos").alias("hi")))

    by_text = Window.partitionBy("doc_id", "text_key", "template").orderBy("diagonal")
    step = lambda c: F.col(c) - F.lag(c).over(by_text)
    onward = step("lo") * (step("lo") - step("diagonal")) > 0  # both ahead in text and template, or both back
    opens = F.when((step("diagonal") <= slack) & onward, 0).otherwise(1)
    runs = votes.where("template is not null").withColumn("opens", opens).withColumn("run", F.sum("opens").over(by_text))
    spans = runs.groupBy("doc_id", "text_key", "template", "run").agg(F.size(F.array_distinct(F.flatten(F.collect_list("tset")))).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(F.broadcast(names), "template")
    flag_names = [f"base_{i}" for i in range(len(flags))]
    totals = votes.groupBy("doc_id", "text_key").agg(F.max("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), *(F.max(c).alias(c) for c in flag_names))
    share = F.col("votes") / F.col("size")
    verified = spans.where((F.col("votes") >= F.lit(coverage) * F.col("size")) & (F.col("votes") >= F.lit(density) * (F.col("hi") - F.col("lo") + 1)))
    found = verified.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("own"), F.max(share).alias("share"), F.sort_array(F.collect_list(F.struct("label", (F.col("lo") - 1).alias("first"), (F.col("hi") + k - 2).alias("last"), share.alias("coverage")))).alias("spans"))

    labels = F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(label)) for c, label in zip(flag_names, sorted(set(phrases.values())), strict=True))))
    out = totals.alias("t").join(found.alias("f"), F.expr("t.doc_id <=> f.doc_id and t.text_key <=> f.text_key"), "left").select("t.*", labels.alias("base"), F.coalesce("own", F.array().cast("array<string>")).alias("own"), "share", "spans")
    per_copy = F.col("n_base") / F.greatest(F.col("copies"), F.lit(1))  # equal rows vote together
    out = out.select("doc_id", "text_key", "n_words", per_copy.cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "own")), ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), "spans", "copies")
    return N.each_copy(out, "copies")
