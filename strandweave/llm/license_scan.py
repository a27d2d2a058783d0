"""Licence scan: entire texts against the digests of known licences, built of SQL functions only."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Equivalent spellings, applied in this order to lower-case words.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"),
    ("whilst", "while"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("acknowledgement", "acknowledgment"),
    ("http", "https"),
)

MIT = """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD0 = ISC.replace("ISC License", "Zero-Clause BSD").replace(", provided that the above copyright notice and this permission notice appear in all copies", "")
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
UNLICENSE_HEAD = "This is free and unencumbered software released into the public domain."

#: (licence id, text) of the known licences and standard licence statements.
KNOWN = (
    ("MIT", MIT),
    ("MIT", MIT.removeprefix("MIT License\n")),
    ("MIT", "Released under the MIT License."),
    ("ISC", ISC),
    ("ISC", ISC.removeprefix("ISC License\n")),
    ("0BSD", BSD0),
    ("0BSD", BSD0.removeprefix("Zero-Clause BSD\n")),
    ("Apache-2.0", APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Unlicense", UNLICENSE_HEAD),
)

#: Headings under which the shorter texts also come.
HEADINGS = {"MIT": ("The MIT License", "The MIT License (MIT)"), "BSD-2-Clause": ("BSD 2-Clause License", 'BSD 2-Clause "Simplified" License'), "BSD-3-Clause": ("BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License'), "Zlib": ("zlib License", "The zlib License")}
#: The end of the terms of the licences that go on with instructions for their use.
END = "END OF TERMS AND CONDITIONS"


def whole_texts() -> tuple[tuple[str, str], ...]:
    """(licence id, text) of the whole licences in ``licences``: as they are, under their headings, and up to the end of their terms."""
    texts = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
    texts.append(("MIT", MIT.removeprefix("MIT License\n")))
    headed = [(n, f"{h}\n{t}") for n, t in texts for h in HEADINGS.get(n, ())]
    ended = [(n, t[: t.index(END) + len(END)]) for n, t in texts if END in t]
    return (*texts, *headed, *ended)


#: A line that only states who holds the rights, and since when.
COPYRIGHT_LINE = r"(?:^|\n)[ \t]*(?:copyright[ \t:,(©0-9]|\(c\)|©|all rights reserved)[^\n]*"

#: The same behind a comment mark.
COMMENTED_LINE = COPYRIGHT_LINE.replace(r"[ \t]*", r"[ \t#*/;%!<>|'\".-]*", 1)


def canonical(text: Column, line: str = COPYRIGHT_LINE) -> Column:
    """Lower case, no copyright lines, single blanks between words of letters and digits, one spelling for each word."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), line, " ")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")
    out = F.concat(F.lit(" "), F.replace(F.trim(out), F.lit(" "), F.lit("  ")), F.lit(" "))  # each word has blanks of its own
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per digest: a digest that several known texts share has the smallest licence id."""
    rows = spark.createDataFrame(list(known if known is not None else (*KNOWN, *whole_texts())), "license string, known_text string")
    text = F.explode(F.array(*(canonical(F.col("known_text"), line) for line in (COPYRIGHT_LINE, COMMENTED_LINE)))).alias("norm")
    return rows.select("license", text).select("license", F.sha2("norm", 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_norm_chars, digest, license, is_license) of each row of ``docs``; license is null where no known text equals the whole one.

    A text with copyright lines behind comment marks is also looked up without these; its digest stays that of the text
    with them. Nulls and empty texts have the digest of the empty text and no licence. A null doc_id stays. Repeated rows
    each give a row, ties (texts alike after normalising) the same licence; an empty table gives none; other columns are
    ignored, whatever their names. The known texts are code, tens of rows, so their side of the hash joins has a fixed bound.
    """
    few = F.broadcast if known is None else lambda own: own  # a caller's table may have any size
    known = known_digests(docs.sparkSession) if known is None else known
    text = F.col("text")
    bare = F.when(F.lower(text).rlike(COMMENTED_LINE), F.sha2(canonical(text, COMMENTED_LINE), 256))
    norm = docs.select("doc_id", canonical(text).alias("norm"), bare.alias("bare"))
    keyed = norm.select("doc_id", F.length("norm").cast("long").alias("n_norm_chars"), F.sha2("norm", 256).alias("digest"), "bare")
    out = keyed.join(few(known.select(F.col("digest"), F.col("license").alias("own"))), "digest", "left")
    out = out.join(few(known.select(F.col("digest").alias("bare"), F.col("license").alias("other"))), "bare", "left")
    found = F.coalesce("own", "other")
    return out.select("doc_id", "n_norm_chars", "digest", found.alias("license"), found.isNotNull().alias("is_license"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower(coalesce({x}, '')), {_quoted(COPYRIGHT_LINE)}, ' ', 'g')"
    out = f"' ' || replace(trim(regexp_replace({out}, {_quoted(r'[^\p{L}\p{N}]+')}, ' ', 'g')), ' ', '  ') || ' '"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(replace({out}, '  ', ' '))"


ORACLE = f"""
WITH known AS (
  SELECT sha256({_sql_canonical('t')}) AS digest, min(l) AS license
  FROM (VALUES {', '.join(f'({_quoted(n)}, {_quoted(t)})' for n, t in KNOWN)}) v(l, t) GROUP BY 1
), norm AS (SELECT doc_id, {_sql_canonical('text')} AS norm FROM documents)
SELECT doc_id, length(norm)::BIGINT AS n_norm_chars, sha256(norm) AS digest, license, license IS NOT NULL AS is_license
FROM norm LEFT JOIN known ON sha256(norm) = known.digest
"""
