"""Licence scans: known licence sentences, then ordered rules over their identifiers.

DataFrame functions only. Texts are cut in two ways: at line ends and sentence ends (notices on a line of their own)
and, with lines joined, at sentence ends alone (sentences that are wrapped over lines); a colon at a line's end ends a
sentence. Every piece is normalised and
looked up among the known sentences, a fixed list that is broadcast. The identifiers found, in the order of the text,
are matched against the rules in their order: a rule consumes the identifiers that it matches.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecohort.llm.common import ascii_lower, table

# Sentences of well-known licences and notices, by identifier.
SENTENCES: list[tuple[str, str]] = [
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("as-is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("mit-short", "Released under the MIT License"),
    ("mit-short", "Licensed under the MIT License"),
    ("mit-short", "This project is licensed under the MIT License"),
    ("mit-short", "SPDX-License-Identifier: MIT"),
    ("apache-short", "Licensed under the Apache License, Version 2.0"),
    ("apache-short", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-short", "This project is licensed under the Apache License, Version 2.0"),
    ("apache-short", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-comply", "you may not use this file except in compliance with the License"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-basis", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("gpl3-short", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-short", "Licensed under the GNU General Public License, version 3"),
    ("gpl3-short", "SPDX-License-Identifier: GPL-3.0-only"),
    ("gpl3-short", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("gpl3-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl2-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl2-short", "SPDX-License-Identifier: GPL-2.0-only"),
    ("gpl2-short", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("gpl-no-warranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-endorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd3-short", "SPDX-License-Identifier: BSD-3-Clause"),
    ("bsd2-short", "SPDX-License-Identifier: BSD-2-Clause"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc-short", "SPDX-License-Identifier: ISC"),
    ("mpl-short", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-short", "SPDX-License-Identifier: MPL-2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0"),
    ("reserved", "All rights reserved"),
]

#: In order: the licence, its identifiers one after another, and whether the text may be used freely, with terms, or not.
RULES: list[tuple[str, list[str], str]] = [
    ("MIT", ["mit-grant", "mit-notice", "as-is"], "free"),
    ("MIT", ["mit-grant", "mit-notice"], "free"),
    ("MIT", ["mit-short"], "free"),
    ("Apache-2.0", ["apache-short", "apache-comply", "apache-copy", "apache-basis"], "free"),
    ("Apache-2.0", ["apache-short", "apache-comply"], "free"),
    ("Apache-2.0", ["apache-short"], "free"),
    ("GPL-3.0-or-later", ["gpl3-or-later", "gpl-no-warranty"], "terms"),
    ("GPL-3.0-or-later", ["gpl3-or-later"], "terms"),
    ("GPL-3.0", ["gpl3-short"], "terms"),
    ("GPL-2.0-or-later", ["gpl2-or-later", "gpl-no-warranty"], "terms"),
    ("GPL-2.0-or-later", ["gpl2-or-later"], "terms"),
    ("GPL-2.0", ["gpl2-short"], "terms"),
    ("GPL-2.0-only", ["gpl-redistribute", "gpl2-version"], "terms"),
    ("GPL-3.0-only", ["gpl-redistribute", "gpl3-version"], "terms"),
    ("GPL-1.0-or-later", ["gpl-redistribute"], "terms"),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"], "free"),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"], "free"),
    ("BSD-3-Clause", ["bsd3-short"], "free"),
    ("BSD-2-Clause", ["bsd2-short"], "free"),
    ("ISC", ["isc-grant"], "free"),
    ("ISC", ["isc-short"], "free"),
    ("MPL-1.1", ["mpl-short", "mpl-version-1-1"], "terms"),
    ("MPL-2.0", ["mpl-short"], "terms"),
    ("Unlicense", ["unlicense"], "free"),
    ("CC0-1.0", ["cc0"], "free"),
    ("CC-BY-4.0", ["cc-by"], "free"),
    ("CC-BY-SA-4.0", ["cc-by-sa"], "terms"),
    ("CC-BY-NC-4.0", ["cc-by-nc"], "closed"),
    ("CC-BY-ND-4.0", ["cc-by-nd"], "closed"),
    ("LicenseRef-all-rights-reserved", ["reserved"], "closed"),
]

#: Pieces of sentences with a sentence end inside, in place of the longest piece. Without a version piece the GPL's notice
#: is for any version, as its terms say.
_REDISTRIBUTE = "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
PIECES: list[tuple[str, str]] = [
    ("gpl-program", "This program is free software"),
    ("gpl-redistribute", _REDISTRIBUTE),
    ("gpl-redistribute", "This program is free software: " + _REDISTRIBUTE),
    ("gpl2-version-or-later", "either version 2 of the License, or (at your option) any later version"),
    ("gpl3-version-or-later", "either version 3 of the License, or (at your option) any later version"),
    ("gpl2-version", "version 2 of the License"),
    ("gpl2-version", "version 2"),
    ("gpl3-version", "version 3 of the License"),
    ("gpl3-version", "version 3"),
    ("mpl-version-2-0", "2.0"),
    ("mpl-version-1-1", "1.1"),
]
#: Pieces in sequence that are a whole sentence, by its identifier.
WHOLE: list[tuple[list[str], str]] = [
    (["gpl-program", "gpl-redistribute"], "gpl-redistribute"),
    (["gpl-redistribute", "gpl2-version-or-later"], "gpl2-or-later"),
    (["gpl-redistribute", "gpl3-version-or-later"], "gpl3-or-later"),
    (["mpl-short", "mpl-version-2-0"], "mpl-short"),
]
#: A version is one only right after what it is the version of; what stands elsewhere says nothing.
_STRAY = r"(?<!,gpl-redistribute,),gpl[23]-version,|(?<!,mpl-short,),mpl-version-1-1,|,(gpl-program|gpl[23]-version-or-later|mpl-version-2-0),"

_RANK = {"free": 1, "terms": 2, "closed": 3}
_END = r"[.;!?]+(\s+|$)"


def normal(s: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()


def _known() -> list[tuple[str, str]]:
    """Identifier and normalised sentence; a sentence with a sentence end inside is known by its longest piece."""
    out = {}
    for k, s in SENTENCES:
        out[max((normal(x) for x in re.split(_END, s) if x and x.strip()), key=len)] = k
    return [(k, s) for s, k in out.items()]


def _scanned() -> list[tuple[str, str]]:
    """Identifier and normalised sentence or piece, with every piece of a sentence under its own identifier."""
    own = {normal(s): k for k, s in PIECES}
    return [(k, s) for k, s in _known() if s not in own] + [(k, s) for s, k in own.items()]


_SHORTEST = min(len(s) for _, s in _scanned())


def _norm(c: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", " "))


def _sequences(docs: DataFrame, known: DataFrame, pieces: Column, name: str) -> DataFrame:
    """``__id, __t`` and the identifiers found in the pieces, as ``,a,b,``, in the order of the text."""
    got = docs.select("__id", "__t", F.posexplode(pieces).alias("__i", "__p"))
    got = got.filter(F.length("__p") >= _SHORTEST).select("__id", "__t", "__i", _norm(F.col("__p")).alias("__s"))
    hit = got.join(F.broadcast(known), "__s").select("__id", "__t", "__i", "__k").distinct()
    keys = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__k"))), lambda x: x["__k"])
    got = hit.groupBy("__id", "__t").agg(F.concat(F.lit(","), F.array_join(keys, ",,"), F.lit(",")).alias(name))
    seq = F.col(name)
    for parts, whole in WHOLE:
        seq = F.replace(seq, F.lit(f",{',,'.join(parts)},"), F.lit(f",{whole},"))
    return got.withColumn(name, F.regexp_replace(seq, _STRAY, "")).filter(F.length(name) > 0)


def _applied(seq: Column) -> Column:
    """The licences that the rules find in a sequence, each once, in the order of the rules."""
    left, found = F.coalesce(seq, F.lit("")), []
    for name, ids, _ in RULES:
        pattern = ",,".join(ids)
        pattern = f",{pattern},"
        found.append(F.when(F.instr(left, pattern) > 0, F.lit(name)))
        left = F.replace(left, F.lit(pattern), F.lit("|"))
    return F.array_distinct(F.array_compact(F.array(*found)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id, sentences`` (identifiers in order, of whole lines and sentences),
    ``licenses`` (in the order of the rules, comma-joined), ``n_licenses, use`` (the strictest: free, terms, closed or
    none).

    A null or empty text has none. Repeated rows give equal rows; a null id is an id like any other; other columns play
    no part.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame([(s, k) for k, s in _scanned()], "__s string, __k string")  # the fixed list
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__id"), F.xxhash64(text_col).alias("__t"), F.col(text_col).alias("__text"))
    lines = _sequences(base, known, F.split("__text", r"[\n\r]+|[.;!?]+[\x20\x09-\x0D]+"), "__lines")
    joined = _sequences(base, known, F.split(F.regexp_replace(F.regexp_replace("__text", r":[\x20\x09]*[\n\r]", ". "), r"[\x20\x09-\x0D]+", " "), r"[.;!?]+ "), "__joined")
    found = lines.join(joined, ["__id", "__t"], "full")
    names = F.array_union(_applied(F.col("__lines")), _applied(F.col("__joined")))
    order = {name: i for i, (name, _, _) in reversed(list(enumerate(RULES)))}
    every = F.array(*[F.lit(x) for x in sorted(order, key=order.get)])
    found = found.withColumn("__names", F.array_intersect(every, names))
    strict = F.array(*[F.lit(_RANK[next(u for n, _, u in RULES if n == x)]) for x in sorted(order, key=order.get)])
    rank = F.array_max(F.transform("__names", lambda x: F.element_at(strict, F.array_position(every, x).cast("int"))))
    found = found.withColumn("__rank", rank)
    key = docs.select(F.col(id_col).alias("__own"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("__id"), F.xxhash64(text_col).alias("__t"))
    got = key.join(found, ["__id", "__t"], "left")
    seen = F.when(F.length(F.coalesce("__joined", F.lit(""))) > F.length(F.coalesce("__lines", F.lit(""))), F.col("__joined")).otherwise(F.coalesce("__lines", F.lit("")))
    return got.select(
        F.col("__own").alias(id_col),
        F.trim(F.regexp_replace(seen, ",+", " ")).alias("sentences"),
        F.coalesce(F.array_join("__names", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.size("__names"), F.lit(0)).cast("int").alias("n_licenses"),
        F.when(F.col("__rank") == 3, "closed").when(F.col("__rank") == 2, "terms").when(F.col("__rank") == 1, "free").otherwise("none").alias("use"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    known = ", ".join(f"('{s}', '{k}')" for k, s in _scanned())

    def whole(seq: str) -> str:
        """Pieces in sequence as their sentence; versions that follow what they are the version of are kept, others go."""
        for parts, name in WHOLE:
            seq = f"replace({seq}, ',{',,'.join(parts)},', ',{name},')"
        for of, version in (("gpl-redistribute", "gpl2-version"), ("gpl-redistribute", "gpl3-version"), ("mpl-short", "mpl-version-1-1")):
            seq = f"replace({seq}, ',{of},,{version},', ',{of},#{version}#')"
        return f"replace(regexp_replace({seq}, ',(gpl[23]-version|gpl[23]-version-or-later|gpl-program|mpl-version-1-1|mpl-version-2-0),', '', 'g'), '#', ',')"

    piece = lambda cut: f"""SELECT doc_id, {whole("',' || string_agg(k, ',,' ORDER BY i) || ','")} AS seq FROM (
      SELECT doc_id, i, trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')) AS s
      FROM (SELECT doc_id, unnest(w) AS p, generate_subscripts(w, 1) AS i FROM (SELECT doc_id, {cut} AS w FROM documents))) JOIN known USING (s) GROUP BY doc_id"""  # noqa: E731

    def applied(seq: str) -> tuple[str, list[str]]:
        steps, names, left = [], [], seq
        for j, (name, ids, _) in enumerate(RULES):
            pat = "," + ",,".join(ids) + ","
            steps.append(f"CASE WHEN contains({left}, '{pat}') THEN '{name}' END")
            left = f"replace({left}, '{pat}', '|')"
        return f"[{', '.join(steps)}]", names

    order: dict[str, str] = {}
    for name, _, use in RULES:
        order.setdefault(name, use)
    every = ", ".join(f"'{x}'" for x in order)
    use = lambda u: ", ".join(f"'{n}'" for n, x in order.items() if x == u)
    return f"""
WITH known(s, k) AS (VALUES {known}),
a AS ({piece(r"regexp_split_to_array(text, '[\n\r]+|[.;!?]+[\x20\x09-\x0D]+')")}),
b AS ({piece(r"regexp_split_to_array(regexp_replace(regexp_replace(text, ':[\x20\x09]*[\n\r]', '. ', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), '[.;!?]+ ')")}),
c AS (SELECT doc_id, coalesce(a.seq, '') AS x, coalesce(b.seq, '') AS y FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)),
n AS (SELECT doc_id, x, y, list_filter([{every}], lambda v: list_contains({applied('x')[0]}, v) OR list_contains({applied('y')[0]}, v)) AS names FROM c)
SELECT doc_id, trim(regexp_replace(CASE WHEN length(y) > length(x) THEN y ELSE x END, ',+', ' ', 'g')) AS sentences,
       array_to_string(names, ',') AS licenses, len(names)::INTEGER AS n_licenses,
       CASE WHEN list_has_any(names, [{use('closed')}]) THEN 'closed' WHEN list_has_any(names, [{use('terms')}]) THEN 'terms'
            WHEN list_has_any(names, [{use('free')}]) THEN 'free' ELSE 'none' END AS use
FROM n
"""


SQL = _sql()
