"""Licence scans by canonical digests.

A text is normalised (case, copyright lines, equivalent spellings, punctuation, white space), and the digest
of the whole is looked up among the digests of known licence texts by a hash join. Lines of a text, which
often hold a notice, are texts of their own in a second lookup. The known texts are a fixed short list (the
notices below and the whole texts in ``license_texts``), so their side of the join is broadcast.

The digest that is given out is of the canonical text of the SQL. The lookup knows a second one, of the letters
and digits alone, which typographic marks, line breaks and hyphens do not change.

Defined cases: a null text has a null digest and no licence; an empty or all-punctuation text has the digest
of the empty string and no licence; equal rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spellings that count as the same, and the known texts.
EQUIVALENT = [
    ("licence", "license"),
    ("non-infringement", "noninfringement"),
    ("sub-license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("authoris", "authoriz"),
    ("merchantibility", "merchantability"),
    ("noncommercial", "non-commercial"),
    ("per cent", "percent"),
    ("copyright owner", "copyright holder"),
    ("https://", "http://"),
    ("gnu gpl", "gnu general public license"),
    ("version ", "v"),
    ("creative commons attribution", "cc by"),
    ("&", " and "),
]
COPYRIGHT_LINE = r"(?m)^[ \t]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
)
KNOWN = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Released under CC0 1.0."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        f"substantial portions of the Software.\n\n{_WARRANTY} IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES "
        "OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

# The second canonical text: a line is a copyright line unless a wrapped sentence of a licence goes on in it.
HOLDER_LINE = (
    r"(?m)^[\t\p{Zs}]*((copyright(?=[\s\p{Z}:])(?![\s\p{Z}]+(and|are|disclaimer|doctrines|holders?|if|interests?|laws?|licen[cs]es?|notices?|on|or|owners?|ownership|"
    r"permissions?|statements?|the|treaty|rights?|\(c\) year name)\b)|\(c\)[\s\p{Z}]*(copyright|[0-9]{4})|©)[^\r\n]*|all rights reserved[^a-z\r\n]*)$"
)
UNSEEN = r"[\u00AD\u200B-\u200D\u2060\uFEFF]+"
ALL_MARKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]+"
#: Letters of which each known text holds some. No equivalent spelling makes them of others, but for "gnu gpl", which is one.
ANCHORS = ("licen", "gnugpl", "redistribution", "permissionto", "releasedunder")
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F\p{P}\p{S}\p{Z}\p{Cc}\p{Cf}]*"
#: Headings that whole texts without one of their own are found under.
HEADINGS = {
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
}
#: The end of the terms, after which an appendix may be left out, and addresses in older copies.
_TERMS = "END OF TERMS AND CONDITIONS"
_OLD = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA", "675 Mass Ave, Cambridge, MA 02139, USA"]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, MARKS, " "))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def letters_digest(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), UNSEEN, ""), HOLDER_LINE, "")
    out = F.regexp_replace(out, r"[\s\p{Z}]+", " ")
    for a, b in EQUIVALENT:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.sha2(F.regexp_replace(out, ALL_MARKS, "").cast("binary"), 256)


def may_be_known(text: Column) -> Column:
    """Whether a text holds the letters of an anchor, whatever marks stand between them: one pass instead of all spellings' replacements.
    (A word that a copyright line cuts in two isn't seen as one.)"""
    return text.rlike("(?i)" + "|".join(_BETWEEN.join(anchor) for anchor in ANCHORS))


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of the whole licences, with and without heading and appendix, and with the old addresses in them."""
    out = [("MIT", KNOWN["MIT"][2].split("\n", 1)[1])]
    out += [(path.stem, path.read_text("utf-8")) for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    out += [(name, text[: text.index(_TERMS) + len(_TERMS)]) for name, text in out if _TERMS in text]
    out += [(name, text.split("\n", 1)[1]) for name, text in out if text.startswith("Creative Commons Legal Code\n")]
    out += [(name, re.sub(r"51 Franklin[^<]*?USA", old, text)) for name, text in out if "51 Franklin" in text for old in _OLD]
    out += [(name, text.replace("licenses/why-not-lgpl", "philosophy/why-not-lgpl")) for name, text in out if "licenses/why-not-lgpl" in text]
    return out + [(name, f"{heading}\n{text}") for name, text in out for heading in HEADINGS.get(name, ())]


def known(spark) -> DataFrame:
    """(known_digest, license) of the fixed list."""
    texts = spark.createDataFrame([(name, text) for name, texts in KNOWN.items() for text in texts], "license string, text string")
    return texts.select(digest(F.col("text")).alias("known_digest"), "license").groupBy("known_digest").agg(F.min("license").alias("license"))


def known_letters(spark) -> DataFrame:
    """(letters_digest, letters_license) of the fixed list and the whole texts."""
    texts = [(name, text) for name, texts in KNOWN.items() for text in texts] + whole_texts()
    texts = spark.createDataFrame(texts, "license string, text string").select(letters_digest(F.col("text")).alias("letters_digest"), "license")
    return texts.groupBy("letters_digest").agg(F.min("license").alias("letters_license"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest, license (of the whole text), n_license_lines, line_license (the first by name)."""
    lookup, letters = F.broadcast(known(docs.sparkSession)), F.broadcast(known_letters(docs.sparkSession))
    text = F.col("text").cast("string")
    lines = docs.select("doc_id", text.alias("text")).filter(may_be_known(F.col("text")))
    lines = lines.select("doc_id", F.xxhash64("text").alias("key"), F.posexplode(F.split("text", "\n")).alias("at", "line")).filter(may_be_known(F.col("line")))
    lines = lines.select("doc_id", "key", "at", letters_digest(F.col("line")).alias("letters_digest")).join(letters, "letters_digest")
    lines = lines.dropDuplicates(["doc_id", "key", "at"]).groupBy(F.col("doc_id").alias("_doc"), "key").agg(F.count("*").alias("lines"), F.min("letters_license").alias("line_license"))
    whole = docs.select("doc_id", F.xxhash64(text).alias("_key"), digest(text).alias("digest"), F.when(may_be_known(text), letters_digest(text)).alias("letters_digest"))
    out = whole.join(lookup, whole["digest"] == F.col("known_digest"), "left").join(letters, "letters_digest", "left")
    out = out.withColumn("license", F.coalesce("license", "letters_license"))
    out = out.join(lines, out["doc_id"].eqNullSafe(F.col("_doc")) & (F.col("_key") == F.col("key")), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("lines", F.lit(0)).cast("long").alias("n_license_lines"), "line_license")


def oracle() -> str:
    """DuckDB SQL for ``scan`` over ``documents``; for tables whose equal ids hold equal texts."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def digest_sql(column: str) -> str:
        out = f"regexp_replace(lower({column}), {quoted(COPYRIGHT_LINE)}, '', 'g')"
        for a, b in EQUIVALENT:
            out = f"replace({out}, {quoted(a)}, {quoted(b)})"
        return f"sha256(trim(regexp_replace({out}, {quoted(MARKS)}, ' ', 'g')))"

    rows = ", ".join(f"({quoted(name)}, {quoted(text)})" for name, texts in KNOWN.items() for text in texts)
    return f"""
    WITH known AS (SELECT {digest_sql('t')} AS known_digest, min(license) AS license FROM (VALUES {rows}) v(license, t) GROUP BY 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    found AS (SELECT doc_id, count(*) AS n, min(license) AS line_license FROM lines JOIN known ON known_digest = {digest_sql('line')} GROUP BY 1)
    SELECT d.doc_id, {digest_sql('d.text')} AS digest, k.license, coalesce(f.n, 0) AS n_license_lines, f.line_license
    FROM documents d LEFT JOIN known k ON k.known_digest = {digest_sql('d.text')} LEFT JOIN found f ON f.doc_id = d.doc_id"""
