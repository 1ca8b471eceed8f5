"""Licence texts by canonical digest, in DataFrame functions only.

A text is put into a canonical form: lower case, copyright lines gone, equivalent
spellings made one, punctuation and white space one space. Its MD5 is looked up
among the digests of known licence texts. Units are whole documents, single lines
and runs of lines, each compared as an entire text; all come from one pass over a
document. A run starts at a line whose first word starts a known text and ends
with a line, after as many words as a known text with that first word has.
The check SQL covers the notices of KNOWN as whole documents and lines; licence
texts over several lines are compared with brute force in the tests.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence notices and short licence texts, by SPDX identifier.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License. See LICENSE for details."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("ISC",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
     "that the above copyright notice and this permission notice appear in all copies."),
    ("MIT",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
     "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
     "furnished to do so, subject to the following conditions:\n"
     "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
     "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
     "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
     "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]
_MIT = KNOWN[-1][1]
_ISC = f"""{KNOWN[-2][1]}
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
{0}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
{1}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """{2}Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
# Whole licence texts that are short, with the titles they are used with (also without one).
_SHORT = [
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)"), (_MIT,)),
    ("ISC", ("ISC License", "The ISC License"), (_ISC, _ISC.replace("and/or distribute", "and distribute"))),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "All rights reserved."),
     tuple((_BSD_HEAD + _BSD_TAIL).format(*marks) for marks in (("1. ", "2. ", "3. "), ("* ",) * 3))),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "All rights reserved."),
     tuple((_BSD_HEAD + _BSD_THIRD + _BSD_TAIL).format(*marks) for marks in (("1. ", "2. ", "3. "), ("* ",) * 3))),
]
# Filled title lines of the long texts, which are files beside this module.
_LONG = {"Apache-2.0": 3, "GPL-2.0": 2, "GPL-3.0": 2, "LGPL-2.1": 2, "LGPL-3.0": 2, "MPL-2.0": 1, "CC0-1.0": 2}
_APPENDICES = ("APPENDIX: How to apply", "How to Apply These Terms")


def full_texts() -> list[tuple[str, str]]:
    """Whole licence texts by SPDX identifier: with and without title, long ones also without their appendix."""
    out = []
    for license, titles, bodies in _SHORT:
        heads = ["", *(f"{t}\n" for t in titles), *(f"{t}\nAll rights reserved.\n" for t in titles if license[:3] == "BSD")]
        out += [(license, head + body) for body in bodies for head in heads]
    for license, n in _LONG.items():
        whole = (Path(__file__).with_name("license_texts") / f"{license}.txt").read_text()
        ends = [len(whole), *(whole.index(a) for a in _APPENDICES if a in whole)]
        for text in (whole[:end] for end in ends):
            filled = [line for line in text.split("\n") if line.strip()]
            out += [(license, text), (license, "\n".join(filled[n:]))]
    return out


# Spellings that count as one.
SPELLINGS = [("licenc", "licens"), ("organis", "organiz"), ("authoris", "authoriz"), ("https", "http"), ("favour", "favor"), ("sub-license", "sublicense")]
# A copyright line is no line of running text that happens to start with the word, or with (c) as a list mark.
_RUNNING = r"(?![ \t]+(?:notices?|holders?|owners?|ownership|licen[sc]es?|laws?|statements?|interests?|rights?|permissions?|disclaimers?|doctrines|treaty|and|or|on|in|to|for|of|if|is|are|the)\b)"
_COPYRIGHT = rf"(?m)^[ \t]*(?:copyright{_RUNNING}|\(c\)(?![ \t]+(?:you|under)\b)|©)[^\n]*$"
_NOISE = r"[^a-z0-9\n]+"


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line of a text, empty ones included, in order."""
    out = F.regexp_replace(F.lower(text), _COPYRIGHT, "")
    for spelling, usual in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(usual))
    return F.transform(F.split(F.regexp_replace(out, _NOISE, " "), "\n", -1), lambda line: F.trim(line))


def _whole(lines: Column) -> Column:
    return F.array_join(F.array_remove(lines, ""), " ")


def _head(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def known_texts(known: DataFrame) -> DataFrame:
    """One row, ``texts``: for each first word the words, digest and licence of known texts (license, text); the first licence of equal texts wins."""
    text = known.select("license", _whole(canonical_lines(F.col("text"))).alias("text")).filter("text <> ''")
    entry = F.struct(F.size(F.split("text", " ")).alias("size"), F.md5(F.col("text").cast("binary")).alias("digest"), F.col("license"))
    one = text.groupBy("text").agg(F.min("license").alias("license"))
    by_head = one.groupBy(_head(F.col("text")).alias("head")).agg(F.collect_list(entry).alias("texts"))
    return by_head.agg(F.map_from_entries(F.collect_list(F.struct("head", "texts"))).alias("texts"))


def _is(line: Column, entry: Column) -> Column:
    return F.md5(line.cast("binary")) == entry["digest"]


def _found_whole(whole: Column, texts: Column) -> Column:
    same = F.filter(F.try_element_at(texts, _head(whole)), lambda e: _is(whole, e))
    return F.coalesce(F.transform(same, lambda e: F.struct(F.lit(-1).alias("unit"), e["license"].alias("license"))), F.array())


def _found_runs(filled: Column, marked: Column, texts: Column) -> Column:
    """(unit, license) of runs of filled lines, also of one, but not of all of several; ``marked`` has | after each line."""
    def is_known(start: Column, e: Column) -> Column:
        run = F.call_function("substring_index", F.array_join(F.slice(marked, start["nth"], e["size"]), " "), F.lit(" "), e["size"])
        all_lines = (start["nth"] == 1) & (F.size(marked) > 1) & (run == F.array_join(marked, " "))
        return run.endswith("|") & _is(F.replace(run, F.lit("|"), F.lit("")), e) & ~all_lines

    starts = F.transform(filled, lambda s, j: F.struct((j + 1).alias("nth"), s["at"].alias("at"), F.try_element_at(texts, _head(s["line"])).alias("texts")))
    found = F.transform(
        F.filter(starts, lambda t: t["texts"].isNotNull()),
        lambda t: F.transform(F.filter(t["texts"], lambda e: is_known(t, e)), lambda e: F.struct(t["at"].alias("unit"), e["license"].alias("license"))),
    )
    return F.array_distinct(F.flatten(found))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Units of ``docs`` that are a known licence text: doc_id, unit, license.

    unit is -1 for the whole document (of several filled lines) and a line number
    from 0 for a line, or for the first line of a run of lines; a licence found
    twice from one line on is one row. A text inside another, as one without its
    title, is a unit of its own. Null, empty and blank texts and lines match
    nothing. Each repeated row yields its own rows; null ids are kept; other columns
    are not read; empty tables give an empty result. ``known`` (license, text)
    replaces the built-in list.
    """
    if known is None:
        known = docs.sparkSession.createDataFrame(KNOWN + full_texts(), "license string, text string")
    # Each step is a column of its own, so that it is made once a document. The known texts are one row, of their digests only.
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).crossJoin(F.broadcast(known_texts(known)))
    numbered = lines.select("doc_id", "texts", F.transform("lines", lambda x, i: F.struct(i.alias("at"), x.alias("line"))).alias("numbered"))
    filled = numbered.select("doc_id", "texts", F.filter("numbered", lambda s: s["line"] != "").alias("filled"))
    marked = filled.select(
        "doc_id", "texts", "filled", F.transform("filled", lambda s: F.concat(s["line"], F.lit("|"))).alias("marked"),
        F.when(F.size("filled") > 1, F.array_join(F.col("filled.line"), " ")).otherwise(F.lit("")).alias("whole"),
    )
    found = F.concat(_found_whole(F.col("whole"), F.col("texts")), _found_runs(F.col("filled"), F.col("marked"), F.col("texts")))
    return marked.select("doc_id", F.inline(found)).select("doc_id", "unit", "license")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    out = f"regexp_replace(lower({column}), '(?m)^[ \\t]*(?:copyright|\\(c\\)|©)[^\\n]*$', '', 'g')"
    for spelling, usual in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{usual}')"
    return f"list_transform(string_split(regexp_replace({out}, '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda x: trim(x))"


SQL = f"""
WITH known AS (
  SELECT md5(array_to_string(list_filter({_sql_lines('text')}, lambda x: x <> ''), ' ')) AS digest, min(license) AS license
  FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in KNOWN)}) AS k(license, text) GROUP BY 1
), texts AS (SELECT doc_id, {_sql_lines('text')} AS lines FROM documents),
filled AS (SELECT doc_id, lines, list_filter(lines, lambda x: x <> '') AS full_lines FROM texts),
units AS (
  SELECT doc_id, -1 AS unit, array_to_string(full_lines, ' ') AS line FROM filled WHERE len(full_lines) > 1
  UNION ALL
  SELECT doc_id, no - 1 AS unit, lines[no] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS no FROM filled) WHERE lines[no] <> ''
)
SELECT doc_id, unit::INTEGER AS unit, license FROM units JOIN known ON md5(line) = digest
"""
