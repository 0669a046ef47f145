"""Licence scans by canonical digest lookup.

The units looked up are entire texts: the whole text of a document, and each of
its lines, as a notice usually is a line of its own. A unit is put in canonical
form (lower case, copyright lines dropped, equivalent spellings made one,
punctuation and white space to single spaces) and its MD5 digest is hash-joined
to the digests of known texts, which went through the same expressions.

Only units with a marker that all known texts have one of are put in canonical
form; the marker test is exact, as canonical forms keep it. The known texts are
a fixed list (complete texts, in licence_texts and below, with the titles and
forms they are usually given in, and notices), so their table is always
broadcast. Documents without a marker
never leave their row.

Defined cases: null and empty texts have no licence; of a unit that several
rows repeat each row gets its own result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
import textwrap
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

# Spellings made one, in the order they are applied (on words).
SPELLINGS = [("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("favour", "favor"), ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("noninfringement", "non infringement"), ("per cent", "percent")]

# One of these stands in every known text, in lower case.
MARKERS = ["licen", "permission", "redistribution", "warrant"]

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ISC = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'

# Short licence texts and notices, by SPDX identifier.
_NOTICES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS + "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD_2 + _BSD),
    ("BSD-3-Clause", _BSD_2 + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + _BSD),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    *[(x, "SPDX-License-Identifier: " + x) for x in ("MIT", "Apache-2.0", "GPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "MPL-2.0", "CC-BY-4.0", "CC-BY-NC-4.0")],
]

# Titles that texts are headed with.
_TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT", "License: MIT", "Expat License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Revised BSD License", "Modified BSD License", "BSD License", "The BSD License"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD Zero Clause License (0BSD)", "0BSD"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "Unlicense": ["The Unlicense", "Unlicense", "UNLICENSE"],
}


def _forms(licence: str, text: str) -> set[str]:
    """The forms a complete text is usually given in: appendix, links, numbers or bullets, and where it's wrapped at a word that canonical() takes for a copyright line."""
    forms = {text}
    if licence == "Apache-2.0" and "APPENDIX:" in text:
        terms, appendix = text[: text.index("APPENDIX:")], text[text.index("APPENDIX:") :]
        forms |= {terms, terms.replace("END OF TERMS AND CONDITIONS", ""), terms.replace("END OF TERMS AND CONDITIONS", "") + appendix}
        forms |= {x[: x.index("Licensed under the Apache License")] for x in list(forms) if "Licensed under the Apache License" in x}
    for how_to in ("How to Apply These Terms", "Appendix: How to Apply These Terms", "ADDENDUM: How to use this License"):
        forms |= {x[: x.index(how_to)] for x in list(forms) if how_to in x}
    if licence in ("BSD-2-Clause", "BSD-3-Clause"):
        for marks in (["", "", ""], ["a. ", "b. ", "c. "], ["i. ", "ii. ", "iii. "]):
            x = text
            for i, mark in enumerate(marks):
                x = x.replace(f" {i + 1}. ", f" {mark}")
            forms.add(x)
        forms |= {x.replace("Redistributions of source code must", "Redistribution of source code must").replace("Redistributions in binary form", "Redistribution in binary form") for x in list(forms)}
    if licence == "ISC":
        forms |= {x.replace("and/or distribute", "and distribute") for x in list(forms)}
        forms |= {x.replace("the above copyright notice and this permission notice appear in all copies. ", "the above\ncopyright notice and this permission notice appear in all copies.\n") for x in list(forms)}
    if licence == "MIT":
        end = "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER"
        forms |= {x.replace(f"{end}{more} ", f"\n{end}{more}\n") for x in list(forms) for more in ("", " IN", " IN AN", " IN AN ACTION") if end in x}
    forms |= {x.replace("http://", "https://") for x in forms} | {x.replace("https://", "http://") for x in forms}
    return forms


def _wrapped(text: str) -> set[str]:
    """A text of one line as it is left where lines wrapped at any usual width, by paragraph or as one, start with `copyright`, which canonical() drops."""
    apart = re.split(r" (?=THE SOFTWARE IS|THIS SOFTWARE IS|The above copyright|(?:[1-3]\. )?Redistributions |(?:3\. )?Neither )", text)
    out = set()
    for width in range(60, 101):
        for paragraphs, indent in [([text], 0), *((apart, i) for i in (0, 2, 3, 4))]:
            lines = [x for p in paragraphs for x in textwrap.wrap(p, width, subsequent_indent=" " * (indent if re.match(r"[1-3]\. |Redistributions |Neither ", p) else 0))]
            kept = [x for x in lines if not re.match(r"\W*copyright", x, re.I)]
            if len(kept) < len(lines):
                out.add(" ".join(x.strip() for x in kept))
    return out


def _known() -> list[tuple[str, str]]:
    complete = [(f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))]
    out = list(_NOTICES)
    for licence, text in [*complete, *(x for x in _NOTICES[:5])]:
        bodies = sorted(_forms(licence, text))
        if (licence, text) not in complete:
            bodies += sorted(set().union(*map(_wrapped, {text, re.sub(r" [1-3]\. (?=Redist|Neither)", " ", text)})))
        out += [(licence, x) for x in bodies if x != text or (licence, text) in complete]
        out += [(licence, f"{title}\n\n{x}") for title in _TITLES.get(licence, []) for x in bodies]
    return out


#: Known licence texts and notices, by SPDX identifier.
KNOWN = _known()

_COPYRIGHT = r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*$|all rights reserved"


def canonical(unit: Column) -> Column:
    """The canonical form of a text; equal for texts that differ in what doesn't matter."""
    x = F.regexp_replace(F.lower(unit), F.lit(_COPYRIGHT), F.lit(" "))
    x = F.concat(F.lit(" "), F.trim(F.regexp_replace(x, F.lit(r"[^\p{L}\p{N}]+"), F.lit(" "))), F.lit(" "))
    for spelled, as_ in SPELLINGS:
        x = F.replace(x, F.lit(f" {spelled} "), F.lit(f" {as_} "))
    return F.trim(x)


def _marked(unit: Column) -> Column:
    lower = F.lower(unit)
    found = F.lit(False)
    for marker in MARKERS:
        found = found | F.contains(lower, F.lit(marker))
    return found


def known_digests(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(KNOWN, "licence string, known string")
    return rows.select("licence", F.md5(canonical(F.col("known")).cast("binary")).alias("digest")).distinct()


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, whole_text (the licence that the text as a whole is), licences (of the text or a line, sorted, comma-joined), n_notices, per row."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    digest = lambda u: F.md5(canonical(u).cast("binary"))
    marked = own.withColumn("_marked", _marked(F.col("_text")))
    compact = cut_lineage(
        marked.select(
            "doc_id",
            F.xxhash64("_text").alias("_row"),
            F.when(F.col("_marked"), digest(F.col("_text"))).alias("_whole"),
            F.when(F.col("_marked"), F.transform(F.filter(F.split("_text", "\n"), _marked), digest)).alias("_lines"),
        ),
        partitions_per_file=8,
    )
    known = F.broadcast(known_digests(docs.sparkSession))
    units = compact.filter(F.col("_whole").isNotNull()).select(
        "doc_id", "_row", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("_whole").alias("digest"))), F.transform("_lines", lambda d: F.struct(F.lit(False).alias("whole"), d.alias("digest"))))).alias("u")
    )
    # A row that repeats another gives the same units again: they count once.
    places = units.groupBy("doc_id", "_row", "u").agg(F.count(F.lit(1)).alias("_n"))
    rows = compact.groupBy(F.col("doc_id").alias("_i"), F.col("_row").alias("_w")).agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1")
    hits = places.select("doc_id", "_row", "u.whole", "u.digest", "_n").join(known, "digest")
    per_doc = hits.groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_r")).agg(
        F.max(F.when(F.col("whole"), F.col("licence"))).alias("whole_text"),
        F.array_join(F.sort_array(F.collect_set("licence")), ",").alias("licences"),
        F.sum(F.when(~F.col("whole"), F.col("_n")).otherwise(0)).alias("_notices"),
    )
    joined = compact.join(per_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_r")), "left").join(rows, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_row") == F.col("_w")), "left")
    return joined.select("doc_id", "whole_text", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce(F.floor(F.col("_notices") / F.coalesce("_rows", F.lit(1))), F.lit(0)).cast("long").alias("n_notices"))
