"""Licence scans by canonical digests, in DataFrame operations only.

A text is brought to one canonical form (case, punctuation, copyright lines, equivalent spellings), and the digests of the entire
text and of each of its lines are hash-joined with the digests of known licence texts and notices in the same form.
"""

from __future__ import annotations

from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import load

# Identifiers and names of public licences.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "ISC": ("ISC License", "ISC"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "BSD-2-Clause"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "BSD-3-Clause"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL v3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "CC0-1.0": ("CC0 1.0", "CC0 1.0 Universal", "CC0-1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC-BY-NC-SA-4.0"),
}
#: Sentences that a notice may be; `%` stands for the name.
NOTICES = (
    "Licensed under the %.", "Released under the %.", "Distributed under the %.", "Available under the %.", "Published under the %.",
    "This work is licensed under the %.", "This file is licensed under the %.", "This software is licensed under the %.",
    "This project is licensed under the %.", "This document is licensed under the %.", "This code is licensed under the %.",
    "SPDX-License-Identifier: %", "License: %",
)
# Whole texts of short public licences, without their copyright lines.
_GRANT = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
TEXTS = {
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _GRANT,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _GRANT,
}
# What the two BSD texts share, as their published templates have it.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n"
)
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n"
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
#: Title lines of the texts that are published without one of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License", "The ISC License"), "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"), "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
}
#: Texts that stand in files, with the lines of each that are its title.
FILES = {"Apache-2.0": 3, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-3.0": 2, "MPL-2.0": 1, "CC0-1.0": 2, "CC-BY-SA-4.0": 1}


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of every whole text, with and without its title lines; Apache-2.0 also without its appendix."""
    bare = [*TEXTS.items(), ("BSD-2-Clause", _BSD + _AS_IS), ("BSD-3-Clause", _BSD + _NO_NAMES + _AS_IS)]
    found = [(i, title + text) for i, text in bare for title in ("", *(f"{x}\n\n" for x in TITLES[i]))]
    for i, n in FILES.items():
        text = files(__package__).joinpath("licence_texts", f"{i}.txt").read_text(encoding="utf-8")
        lines = [x for x in text.splitlines() if x.strip(" \t=-")]
        for some in (lines[k:] for k in range(n + 1)):
            found.append((i, "\n".join(some)))
            if i == "Apache-2.0":
                end = next(k for k, x in enumerate(some) if "END OF TERMS" in x)
                found += [(i, "\n".join(some[:k])) for k in (end, end + 1)]
    return found


def known_texts(spark: SparkSession) -> DataFrame:
    """(license, known): every whole text and every notice of every name; a fixed table of a few hundred rows."""
    one = spark.range(1)
    lit = lambda a, b: F.struct(F.lit(a).alias("license"), F.lit(b).alias("known"))
    names = one.select(F.explode(F.array(*(lit(i, name) for i, all_names in NAMES.items() for name in all_names))).alias("x")).select("x.*")
    notices = names.select("license", F.explode(F.transform(F.array(*map(F.lit, NOTICES)), lambda s: F.replace(s, F.lit("%"), F.col("known")))).alias("known"))
    whole = one.select(F.explode(F.array(*(lit(i, text) for i, text in whole_texts()))).alias("x")).select("x.*")
    return whole.union(notices)


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line of a text that is not a copyright line."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$", "")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\n]+", " ")
    t = F.regexp_replace(t, r"\b(sub ?)?licenc(e|es|ed|ing|ee|or)\b", "$1licens$2")
    t = F.regexp_replace(t, r"\b(?:version|ver) (?=[0-9])", "v")
    t = F.regexp_replace(t, r"\b(?:the|and or) ", "")
    t = F.regexp_replace(t, r"\bnon (commercial|infringement)\b|\bsub (licens)", "non$1")
    return F.transform(F.split(t, "\n"), lambda x: F.trim(x))


def _digests(lines: Column) -> tuple[Column, Column]:
    """Of the entire text, and of each line; blank ones have none."""
    full = F.filter(lines, lambda x: x != "")
    whole = F.array_join(full, " ")
    return F.when(whole != "", F.md5(whole)), F.array_distinct(F.transform(full, lambda x: F.md5(x)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, digest, whole, licenses for each row of `docs`: the digest of the entire canonical text (null if blank), the known
    licence that the entire text is (or null; the least name of several), and all licences whose text or notice the entire text
    or a line is, ascending, in an array.

    Needs doc_id and text; other columns are not read. A null text is an empty one and has no licence; a null id stays null; repeated rows
    stay. An empty table gives no rows.
    """
    known = known_texts(docs.sparkSession)
    known = known.select("license", _digests(canonical_lines(F.col("known")))[0].alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))
    # the known table is fixed and small: its digests go into the plan, so that texts are read and put in canonical form once
    names = {r.digest: r.license for r in known.collect()}
    whole, parts = _digests(F.col("lines"))
    units = docs.select("doc_id", canonical_lines(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("lines"))
    units = units.select("doc_id", whole.alias("digest"), parts.alias("parts"))
    met = F.filter(F.array_union("parts", F.array("digest")), lambda x: x.isin(*names))
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    units = units.select("doc_id", "digest", F.array_sort(F.array_distinct(F.transform(met, lambda x: F.element_at(table, x)))).alias("licenses"))
    rows = units.join(F.broadcast(known.withColumnRenamed("license", "whole")), "digest", "left")
    return rows.select("doc_id", "digest", "whole", "licenses")


def op10(spark, sf_dir: str) -> DataFrame:
    found = scan(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "digest", "whole", F.array_join("licenses", ",").alias("licenses"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_CANON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t),
    '(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$', '', 'g'), '[^\p{L}\p{N}\n]+', ' ', 'g'),
    '\b(sub ?)?licenc(e|es|ed|ing|ee|or)\b', '\1licens\2', 'g'), '\b(?:version|ver) ([0-9])', 'v\1', 'g'), '\b(?:the|and or) ', '', 'g'),
    '\bnon (commercial|infringement)\b|\bsub (licens)', 'non\1', 'g')"""
OP10_SQL = f"""
WITH names(license, name) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(n)})" for i, ns in NAMES.items() for n in ns)}),
notices(notice) AS (VALUES {", ".join(f"({_quoted(n)})" for n in NOTICES)}),
texts(license, t) AS (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in whole_texts())}),
known AS (SELECT license, replace(notice, '%', name) AS t FROM names, notices UNION ALL SELECT license, t FROM texts),
units AS (SELECT license, CAST(NULL AS BIGINT) AS doc_id, t FROM known UNION ALL SELECT NULL, doc_id, coalesce(text, '') FROM documents),
canon AS (SELECT license, doc_id, list_filter(list_transform(string_split({_CANON}, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM units),
digests AS (SELECT license, doc_id, ls, CASE WHEN len(ls) > 0 THEN md5(array_to_string(ls, ' ')) END AS digest FROM canon),
book AS (SELECT digest, min(license) AS license FROM digests WHERE license IS NOT NULL GROUP BY digest),
lines AS (SELECT DISTINCT doc_id, u FROM (SELECT doc_id, md5(unnest(ls)) AS u FROM digests WHERE license IS NULL UNION ALL SELECT doc_id, digest FROM digests WHERE license IS NULL)),
hits AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM lines JOIN book ON u = book.digest GROUP BY doc_id)
SELECT d.doc_id, d.digest, book.license AS whole, coalesce(licenses, '') AS licenses
FROM digests d LEFT JOIN book ON d.digest = book.digest LEFT JOIN hits ON d.doc_id = hits.doc_id WHERE d.license IS NULL
"""
