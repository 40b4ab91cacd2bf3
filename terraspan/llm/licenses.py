"""Licence scans by canonical digests, in DataFrame functions only.

A document's whole text and each of its lines are brought to a canonical form: lower case, one spelling where licences
have two, punctuation and white space reduced to single spaces; of whole texts, copyright lines are left out. The form
is digested and hash-joined to the digests of known licence texts. Only units as long as some known text are digested.

A known text of several lines is found wherever its words stand in a longer document, however its lines are broken there:
at each word that some known text begins with, the hash of the next words is looked up; where it is that of a known text,
as many words as that has are digested and compared with it. What this costs doesn't depend on how many texts are known.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terraspan.functions.lambdas import let
from terraspan.llm import common

#: Licence texts and notices as their owners word them, by SPDX identifier (or a name of ours where SPDX has none).
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved."),
]
#: Spellings that count as the same.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"), ("copyright owner", "copyright holder")]
#: What is neither a letter nor a digit, of any script.
MARKS = r"[^\p{L}\p{N}]+"
#: Lines that name a copyright's holder. In lower case: with the sign, or with a year.
HOLDER = r"^[^a-z0-9©]*(©|copyright[^a-z0-9]*(©|\(c\))|copyright\b.*\b(19|20)[0-9]{2}\b|\(?c\)?[^a-z0-9]+[0-9]{4})"
#: In canonical form: short ones without either, but for those whose next word is one that follows within licences.
NAMED = r"^(c )?copyright( c)?( by)?( [^ ]+){1,8}$"
NOT_NAMED = r"^(c )?copyright( c)?( by)? (license|licenses|notice|notices|holder|holders|owner|owners|law|laws|act|acts|statement|interest|treaty|status|office|permission|claim|claims|and|or|in|on|to|is|as|of|for|the|this|that|with|under)( |$)"
#: Words whose hash finds where a known text may begin.
ANCHOR = 6
#: What a notice of one line may end with, and titles that MIT's text has besides its own.
ENDINGS = (" See LICENSE for details.", " See the LICENSE file for details.", " See LICENSE for more information.")
TITLES = ("The MIT License (MIT)", "The MIT License")


@lru_cache(1)
def full_texts() -> list[tuple[str, str]]:
    """The whole licences in license_texts, and BSD's with other holders, two clauses, and without "All rights reserved."."""
    found = {f.stem: f.read_text() for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    regents = found["BSD-3-Clause"]
    holder = regents.replace("the University nor", "the copyright holder nor").replace("THE REGENTS AND CONTRIBUTORS", "THE COPYRIGHT HOLDERS AND CONTRIBUTORS").replace("THE REGENTS OR CONTRIBUTORS", "THE COPYRIGHT HOLDER OR CONTRIBUTORS")
    two = lambda x: x[: x.index("3. Neither")] + x[x.index("THIS SOFTWARE") :]
    out = [*found.items(), ("BSD-3-Clause", holder), ("BSD-2-Clause", two(holder)), ("BSD-2-Clause", two(regents))]
    out += [(n, t.replace("All rights reserved.", "")) for n, t in out if n.startswith("BSD")]
    out.append(("Apache-2.0", found["Apache-2.0"][: found["Apache-2.0"].index("APPENDIX:")]))
    mit = next(t for n, t in KNOWN if t.startswith("MIT License\n")).removeprefix("MIT License\n")
    return [*out, ("MIT", mit), *(("MIT", f"{title}\n{mit}") for title in TITLES)]


def notices() -> list[tuple[str, str]]:
    """Notices of one line with what they may end with."""
    own = [(n, t) for n, t in KNOWN if "\n" not in t and " " in t.strip() and not t.startswith(("SPDX", "All"))]
    return [(n, t + e) for n, t in own for e in ENDINGS]


def every_text() -> list[tuple[str, str]]:
    return [*KNOWN, *notices(), *full_texts()]


def sql_canonical(text: str) -> str:
    """The canonical form as an SQL expression that Spark and DuckDB read alike; text is one, too."""
    out = f"lower({text})"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return out


def canonical(line: Column) -> Column:
    out = F.lower(line)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, MARKS, " "))


def named(line: Column, form: Column) -> Column:
    """Does a line, with this canonical form, name a copyright's holder?"""
    return F.lower(line).rlike(HOLDER) | (form.rlike(NAMED) & ~form.rlike(NOT_NAMED))


def units(text: Column) -> Column:
    """(lines, whole): canonical forms of the lines that have one, and that of the whole text without its copyright lines."""
    both = F.transform(F.split(text, "\n"), lambda x: let(canonical(x), lambda f: F.struct(f.alias("form"), named(x, f).alias("named"))))
    kept = F.filter(both, lambda x: x["form"] != "")
    whole = lambda x: F.array_join(F.transform(F.filter(x, lambda y: ~y["named"]), lambda y: y["form"]), " ")
    return let(kept, lambda x: F.struct(F.transform(x, lambda y: y["form"]).alias("lines"), whole(x).alias("whole")))


def joined(words: Column, start: Column, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start + 1, n if isinstance(n, Column) else F.lit(n)), " ")


def anchor(words: Column, start: Column) -> Column:
    return F.xxhash64(joined(words, start, ANCHOR))


def known(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(license, digest, size, words, first, anchor, inside) of the known texts' canonical forms, each once; two licences with one form keep the first name.

    inside: is it a text of several lines, to be found inside of others? first and anchor: its first word, and the hash of
    its first words.
    """
    rows = spark.createDataFrame([(n, t, "\n" in t.strip()) for n, t in texts], "license string, text string, inside boolean")
    forms = rows.select("license", "inside", units(F.col("text"))["whole"].alias("form"), F.element_at(units(F.col("text"))["lines"], 1).alias("line"))
    # a notice is a line of its own, whatever it names
    forms = forms.withColumn("form", F.when(F.col("inside"), F.col("form")).otherwise(F.col("line"))).withColumn("w", F.split("form", " "))
    each = forms.groupBy("form").agg(F.min("license").alias("license"), F.max("inside").alias("inside"), F.first("w").alias("w"))
    return each.select("license", F.sha2("form", 256).alias("digest"), F.length("form").alias("size"), F.size("w").alias("words"), F.get("w", F.lit(0)).alias("first"), anchor(F.col("w"), F.lit(0)).alias("anchor"), "inside")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_lines (lines that are a known licence or notice), licenses (all that were found,
    in order, joined by commas; empty if none), whole_license (the one that the whole text is, null if none).

    A known text of one line is found as a line, or as the whole text; one of several lines as the whole text, or inside
    of it. Copyright lines don't count in either. texts: the known (name, text) pairs; they are few, so they are collected
    and broadcast. Null and empty texts have no findings. Rows that repeat an id and a text have the same findings. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    forms = known(spark, texts or every_text()).collect()
    names = "license string, digest string, size int, words int, first string, anchor long, inside boolean"
    table = F.broadcast(spark.createDataFrame(forms, names))
    parts = [r for r in forms if r.inside and r.words >= ANCHOR]
    sizes, firsts = sorted({r.size for r in forms}), sorted({r.first for r in parts})
    # how many words the known texts have that begin with an anchor
    lengths = {h: sorted({r.words for r in parts if r.anchor == h}) for h in {r.anchor for r in parts}}
    rows = docs.select(F.col(doc_id), common.text_or_empty(text).alias("__text"))
    mark = [common.key_of(doc_id).alias("__key"), F.xxhash64("__text").alias("__hash")]
    digest = lambda kind, form: F.struct(F.lit(kind).alias("kind"), F.sha2(form, 256).alias("digest"))
    nothing = F.array().cast("array<struct<kind:string,digest:string>>")

    def inside(words: Column) -> Column:
        """Where a known text may begin, the digests of as many words as such texts have."""
        starts = F.filter(F.transform(words, lambda w, n: F.when(w.isin(firsts), n)), lambda n: n.isNotNull())
        of = F.create_map(*(x for h, n in lengths.items() for x in (F.lit(h), F.array(*map(F.lit, n)))))
        sizes_at = lambda n: F.coalesce(F.try_element_at(of, anchor(words, n)), F.array().cast("array<int>"))
        return F.flatten(F.transform(starts, lambda n: F.transform(sizes_at(n), lambda size: digest("inside", joined(words, n, size)))))

    def made(u: Column) -> Column:
        lines = F.transform(F.filter(u["lines"], lambda x: F.length(x).isin(sizes)), lambda x: digest("line", x))
        whole = F.when(F.length(u["whole"]).isin(sizes), F.array(digest("whole", u["whole"]))).otherwise(nothing)
        return F.concat(lines, whole, let(F.split(u["whole"], " "), inside) if parts else nothing)

    found = rows.select(*mark, F.explode(let(units(F.col("__text")), made)).alias("d"))
    hits = found.select("__key", "__hash", "d.kind", "d.digest").join(table.select("license", "digest"), "digest")
    # a row's lines are counted within one row of repeated ones, so repeats are told apart by how many there are
    times = rows.groupBy(*mark).agg(F.count(F.lit(1)).alias("__rows"))
    per = hits.groupBy("__key", "__hash").agg(F.sum((F.col("kind") == "line").cast("long")).alias("n"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.min(F.when(F.col("kind") == "whole", F.col("license"))).alias("whole"))
    per = per.join(times, ["__key", "__hash"]).select("__key", "__hash", (F.col("n") / F.col("__rows")).cast("long").alias("n"), "licenses", "whole")
    out = rows.select(doc_id, *mark).join(per, ["__key", "__hash"], "left")
    return out.select(doc_id, F.coalesce("n", F.lit(0)).cast("long").alias("n_lines"), F.coalesce("licenses", F.lit("")).alias("licenses"), F.col("whole").alias("whole_license"))


def query(spark, sf_dir):
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    def canon(text: str) -> str:
        return f"trim(regexp_replace({sql_canonical(text)}, '{MARKS}', ' ', 'g'))"

    quoted = lambda x: x.replace("'", "''")
    values = ", ".join(f"""({k}, '{name}', '{quoted(text)}', {"true" if chr(10) in text.strip() else "false"})""" for k, (name, text) in enumerate(every_text()))
    return f"""
WITH known AS (SELECT * FROM (VALUES {values}) v(k, license, text, inside)),
t AS (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'k', k, text FROM known),
r AS (SELECT kind, id, u.n, u.line, {canon("u.line")} AS form FROM (SELECT kind, id, unnest(list_transform(range(1, len(s) + 1), lambda i: {{'n': i, 'line': s[i]}})) AS u FROM (SELECT kind, id, string_split(text, chr(10)) AS s FROM t))),
l AS (SELECT * FROM r WHERE form <> ''),
w AS (SELECT kind, id, string_agg(form, ' ' ORDER BY n) AS form FROM l WHERE NOT regexp_matches(lower(line), '{HOLDER}') AND NOT (regexp_matches(form, '{NAMED}') AND NOT regexp_matches(form, '{NOT_NAMED}')) GROUP BY kind, id),
forms AS (SELECT form, min(license) AS license, bool_or(inside) AS inside FROM (SELECT w.form, license, true AS inside FROM w JOIN known ON k = id WHERE kind = 'k' AND inside UNION ALL SELECT arg_min(l.form, l.n), any_value(license), false FROM l JOIN known ON k = id WHERE kind = 'k' AND NOT inside GROUP BY id) GROUP BY form),
hit AS (SELECT l.id, 'line' AS kind, license FROM l JOIN forms USING (form) WHERE l.kind = 'd' UNION ALL SELECT w.id, 'whole', license FROM w JOIN forms USING (form) WHERE w.kind = 'd'
UNION ALL SELECT w.id, 'inside', license FROM w JOIN forms f ON f.inside AND contains(' ' || w.form || ' ', ' ' || f.form || ' ') WHERE w.kind = 'd'),
f AS (SELECT id, count(*) FILTER (kind = 'line') AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, min(license) FILTER (kind = 'whole') AS whole FROM hit GROUP BY id)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(licenses, '') AS licenses, whole AS whole_license FROM documents LEFT JOIN f ON id = doc_id
"""


SQL = _sql()
