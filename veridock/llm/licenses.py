"""License scans with a positional rare-token index (native).

Templates are word sequences: licence texts, notices and single statements.
Inverse document frequencies come from the whole corpus; each template is posted
under its highest-IDF words with their positions. A file looks up only those rare
words; postings that agree on the same relative position place the template, its
mandatory key phrase is compared word by word at that place, and the score is the
IDF-weighted share of all its words that stand where they should. Templates are a
fixed list, so the index is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checkpoint, pick, word_array

#: Base phrases and labels.
BASE_PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Fixed values: (label, template, mandatory key phrase), wording of public licence notices.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "person obtaining a copy of this software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc0", "cc0 1 0 universal public domain dedication", "cc0 1 0 universal"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
]

#: Fixed values: (label, wording of a public licence or its notice, mandatory key phrase).
TEXTS = [
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        "to deal in the software without restriction",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
        "with or without fee is hereby granted",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.""",
        "the origin of this software must not be misrepresented",
    ),
    (
        "bsl",
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so""",
        "any person or organization obtaining a copy of the software",
    ),
    (
        "apache",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
        "unless required by applicable law or agreed to in writing",
    ),
    (
        "gpl",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
        "gnu general public license as published by the free software foundation",
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
        "gnu lesser general public license as published by the free software foundation",
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
        "unencumbered software released into the public domain",
    ),
    (
        "cc0",
        """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
        "waived all copyright and related or neighboring rights",
    ),
]

#: Rare words a template is posted under, and the share of their IDF that must agree on one position.
RARE_WORDS = 8
AGREE = 0.6


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def template_rows() -> list[tuple[int, str, str, list[str], list[str], int]]:
    """tid, kind (base or own), label, words, key (mandatory phrase) and where the key starts."""
    rows = [(i, "base", label, phrase.split(), phrase.split(), 0) for i, (phrase, label) in enumerate(BASE_PHRASES)]
    for label, text, key in TEMPLATES + TEXTS:
        words, need = words_of(text), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(need)] == need)
        rows.append((len(rows), "own", label, words, need, at))
    return rows


def rare_index(spark, words: DataFrame) -> DataFrame:
    """Postings word and offset of the templates, each under its highest-IDF words at their first place.

    weights are the IDF of all words in order, rare the IDF of the posted words, whole
    what a full match weighs: for a base phrase the longest wording of its label.
    """
    templates = spark.createDataFrame(template_rows(), "tid int, kind string, label string, words array<string>, key array<string>, key_at int")
    vocabulary = sorted({w for row in template_rows() for w in row[3]})
    met = words.select(F.explode(F.array_intersect("ws", F.array(*map(F.lit, vocabulary)))).alias("word"))
    counts, total = met.groupBy("word").agg(F.count(F.lit(1)).alias("df")), words.count()
    # Of a document of n, df of which have the word: rarer words weigh more, the commonest still a little.
    idf = F.log(1 + (total + 1) / (F.coalesce("df", F.lit(0)) + F.lit(1.0)))
    places = templates.select("tid", F.posexplode("words").alias("offset", "word"))
    weighed = places.join(F.broadcast(checkpoint(counts)), "word", "left").select("tid", "offset", "word", idf.alias("idf"))
    order = F.array_sort(F.collect_list(F.struct("offset", "word", "idf"))).alias("all")
    firsts = F.filter("all", lambda x: F.array_position(F.col("words"), x["word"]) == x["offset"] + 1)
    rarest = F.array_sort(F.transform(firsts, lambda x: F.struct((-x["idf"]).alias("n"), x["offset"].alias("offset"), x["word"].alias("word"))))
    sized = weighed.groupBy("tid").agg(order).join(templates, "tid")
    sized = sized.withColumn("weights", F.transform("all", lambda x: x["idf"])).withColumn("own", F.aggregate("weights", F.lit(0.0), lambda a, x: a + x))
    # A base phrase stands word for word, so its rarest word alone places it.
    sized = sized.withColumn("top", F.slice(rarest, 1, F.when(F.col("kind") == "base", 1).otherwise(RARE_WORDS)))
    sized = sized.withColumn("rare", F.aggregate("top", F.lit(0.0), lambda a, x: a - x["n"]))
    longest = sized.groupBy("label").agg(F.max("own").alias("longest"))
    sized = sized.join(longest, "label").withColumn("whole", F.when(F.col("kind") == "base", F.col("longest")).otherwise(F.col("own")))
    index = sized.select("tid", "kind", "label", "words", "key", "key_at", "weights", "rare", "whole", F.explode("top").alias("p"))
    return checkpoint(index.select("*", F.col("p.word").alias("word"), F.col("p.offset").alias("offset"), (-F.col("p.n")).alias("idf")).drop("p"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the greatest IDF-weighted share of a licence's wording that stands in
    its place: near 1 for a whole text or notice, small for a mere mention. Null
    and empty texts have no words, no labels and score 0. Base phrases are counted
    at every place. Rows that repeat doc_id and text get the same answer. An empty
    table gives an empty result.
    """
    words = pick(docs, doc_id="doc_id", text="text").select("doc_id", F.xxhash64("text").alias("th"), word_array(F.col("text")).alias("ws"))
    # The templates are fixed, so the index has a known size.
    index = rare_index(docs.sparkSession, words)
    at = F.col("pos") - F.col("offset")
    key_from = at + F.col("key_at")
    fits = (key_from >= 0) & (key_from + F.size("key") <= F.size("ws"))
    probe = words.select("doc_id", "th", "ws", F.posexplode("ws").alias("pos", "word")).join(F.broadcast(index), "word")
    verified = probe.where(fits & F.when(fits, F.slice("ws", F.when(fits, key_from + 1).otherwise(1), F.size("key")) == F.col("key")))
    stands = F.transform("words", lambda w, i: F.when((F.col("at") + i >= 0) & (F.get("ws", F.greatest(F.lit(0), F.col("at") + i)) == w), F.get("weights", i)).otherwise(0.0))
    scored = verified.withColumn("at", at).withColumn("share", F.aggregate(stands, F.lit(0.0), lambda a, x: a + x) / F.col("whole"))
    placed = (
        scored.select("doc_id", "th", "tid", "kind", "label", "rare", "at", "idf", "offset", "share")
        .distinct()
        .groupBy("doc_id", "th", "tid", "kind", "label", "rare", "at")
        .agg(F.sum("idf").alias("idf"), F.max("share").alias("share"))
        .where((F.col("kind") == "base") | (F.col("idf") >= AGREE * F.col("rare") - 1e-9))
    )
    base = F.col("kind") == "base"
    found = placed.groupBy("doc_id", "th").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("at"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("at"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.round(F.max(F.least(F.lit(1.0), F.col("share"))), 6).alias("score"),
    )
    found = found.withColumnsRenamed({"doc_id": "d", "th": "t"})
    every = words.select("doc_id", "th", F.size("ws").cast("long").alias("n_words"))
    return every.join(found, every["doc_id"].eqNullSafe(F.col("d")) & (every["th"] == F.col("t")), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
