"""Operator 10, licence scans by canonical digest lookup. DataFrame functions only.

A text is made canonical: lower case, copyright lines dropped, punctuation and white space to single blanks, equivalent
spellings to one, word by word, and of two words after that. The SHA-256 of the result is joined to the digests of known licences, so
only entire texts match. What is looked up are the whole document, each of its lines, and each paragraph (what blank lines
part) of several lines, as notices commonly fill a line or a paragraph, however it is wrapped. The known digests are those of KNOWN, one-line notices
and short texts, and of license_digests_v1.csv, entire licence texts and headers of source files (made by license_table).

Defined results: null, empty and punctuation-only texts match nothing and have a null digest; a text that equals several
known entries reports the smallest name; repeated rows each give their own row; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Spellings that licence matching treats as equal, and known licence notices and short licence texts.
EQUIVALENT = {
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "sublicence": "sublicense",
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "favour": "favor",
    "fulfil": "fulfill",
    "merchantibility": "merchantability",
    "organisation": "organization",
    "whilst": "while",
    "sub license": "sublicense",
    "non commercial": "noncommercial",
}
KNOWN = {
    "All-Rights-Reserved": ["All rights reserved."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "This work is licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "Released under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "GPL-3.0": [
        "Licensed under the GNU General Public License, version 3.",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
    ],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: (license, digest) of entire licence texts and headers; a further version is a further file.
DIGESTS = Path(__file__).with_name("license_digests_v1.csv")

#: A known table of at most so many rows is broadcast (some 100 bytes a row); a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000
_COPYRIGHT = r"^\W*(copyright|\(c\)|©)"


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, in order; copyright lines and empty ones are left out."""

    def one(line: Column) -> Column:
        words = F.trim(F.regexp_replace(line, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " "))
        # two blanks between words, so that neighbours don't share one
        spelt = F.concat(F.lit(" "), F.replace(words, F.lit(" "), F.lit("  ")), F.lit(" "))
        for a, b in EQUIVALENT.items():
            spelt = F.replace(spelt, F.lit(f" {a.replace(' ', '  ')} "), F.lit(f" {b} "))
        return F.trim(F.replace(spelt, F.lit("  "), F.lit(" ")))

    lines = F.filter(F.split(F.lower(text), r"\n"), lambda x: ~(x.contains("copyright") | x.contains("(c)") | x.contains("©")) | ~x.rlike(_COPYRIGHT))
    return F.filter(F.transform(lines, one), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """The canonical lines of each paragraph: of what blank lines part."""
    return F.transform(F.split(text, r"\n[ \t\r]*\n"), canonical_lines)


def digest(canonical: Column) -> Column:
    return F.sha2(canonical.cast("binary"), 256)


def full_texts() -> list[tuple[str, str]]:
    """(license, digest) of the versioned table."""
    with DIGESTS.open(newline="") as f:
        return [(r["license"], r["digest"]) for r in csv.DictReader(f)]


def known_licenses(spark: SparkSession, known: dict[str, list[str]] = KNOWN) -> DataFrame:
    """(license, digest) of known's texts, by the same canonical form, and of the versioned table."""
    rows = [(name, text) for name, texts in known.items() for text in texts]
    texts = spark.createDataFrame(rows, "license string, text string")
    full = spark.createDataFrame(full_texts(), "license string, digest string")
    return digested(texts).select("license", "digest").union(full).groupBy("digest").agg(F.min("license").alias("license"))


def digested(texts: DataFrame) -> DataFrame:
    """Adds digest: of the whole canonical text, null where nothing is left of it."""
    whole = F.array_join(canonical_lines(F.coalesce("text", F.lit(""))), " ")
    return texts.withColumn("digest", F.when(whole != "", digest(whole)))


def scan(docs: DataFrame, known: DataFrame, known_rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_digest, license, n_notices, notices): license of the entire text, or null; lines and paragraphs of several lines that
    are notices, counted, and their licences' names.

    Digests, not texts, are exploded; each document's rows stay in one task until partial aggregation has made them one."""
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), paragraphs(F.coalesce(F.col(text), F.lit(""))).alias("parts"))
    base = base.select("row", "key", F.flatten("parts").alias("lines"), F.filter("parts", lambda p: F.size(p) > 1).alias("parts"))
    whole = F.array_join("lines", " ")
    blocks = F.transform("parts", lambda p: digest(F.array_join(p, " ")))
    # a text of one paragraph is looked up as a whole and as that paragraph
    units = base.select("row", "key", F.concat(F.array(F.when(whole != "", digest(whole))), F.transform("lines", digest), blocks).alias("digests"))
    units = units.select("row", "key", F.posexplode("digests").alias("unit", "digest"))
    side = F.broadcast(known) if known_rows <= BROADCAST_ROWS else known
    whole_one, notice = F.col("unit") == 0, F.col("unit") > 0
    return (
        units.join(side, "digest", "left")
        .groupBy("row")
        .agg(
            F.first("key").alias(key),
            F.max(F.when(whole_one, F.col("digest"))).alias("text_digest"),
            F.max(F.when(whole_one, F.col("license"))).alias("license"),
            F.count(F.when(notice, F.col("license"))).alias("n_notices"),
            F.array_join(F.sort_array(F.collect_set(F.when(notice, F.col("license")))), ",").alias("notices"),
        )
        .drop("row")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), known_licenses(spark), sum(map(len, KNOWN.values())) + len(full_texts()))


def oracle() -> str:
    """The same rows by other means: words are looked up one by one in a map, two-word spellings replaced by a pattern."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, texts in KNOWN.items() for text in texts)
    single = ", ".join(f"'{a}': '{b}'" for a, b in EQUIVALENT.items() if " " not in a)
    word = f"coalesce(map_extract(MAP {{{single}}}, w)[1], w)"
    words = "list_filter(string_split(regexp_replace(l, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda w: w <> '')"
    spelt = f"'  ' || array_to_string(list_transform({words}, lambda w: {word}), '  ') || '  '"
    for a, b in EQUIVALENT.items():
        if " " in a:
            spelt = f"regexp_replace({spelt}, ' {a.replace(' ', '  ')} ', ' {b} ', 'g')"
    keeps = "NOT regexp_matches(l, '^[^0-9A-Za-z_]*(copyright|\\(c\\)|©)')"
    canonical = f"list_filter(list_transform(list_filter(string_split(lower(%s), chr(10)), lambda l: {keeps}), lambda l: trim(regexp_replace({spelt}, ' +', ' ', 'g'))), lambda l: l <> '')"
    return f"""
        WITH known_texts(license, text) AS (VALUES {rows}),
        known AS (
            SELECT digest, min(license) AS license FROM (
                SELECT sha256(array_to_string({canonical % "text"}, ' ')) AS digest, license FROM known_texts
                UNION ALL SELECT digest, license FROM read_csv('{DIGESTS}', header = true, columns = {{'license': 'VARCHAR', 'digest': 'VARCHAR'}})) GROUP BY 1),
        base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
        parts AS (SELECT r, doc_id, list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda p: {canonical % "p"}) AS parts FROM base),
        lines AS (SELECT r, doc_id, parts, flatten(parts) AS lines FROM parts),
        whole AS (SELECT r, doc_id, CASE WHEN len(lines) > 0 THEN sha256(array_to_string(lines, ' ')) END AS text_digest FROM lines),
        units AS (
            SELECT r, unnest(lines) AS body FROM lines
            UNION ALL SELECT r, array_to_string(p, ' ') FROM (SELECT r, unnest(parts) AS p FROM lines) WHERE len(p) > 1),
        notices AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM units JOIN known ON digest = sha256(body) GROUP BY r)
        SELECT doc_id, text_digest, license, coalesce(n, 0) AS n_notices, coalesce(names, '') AS notices
        FROM whole LEFT JOIN known ON digest = text_digest LEFT JOIN notices USING (r)"""
