"""Licence texts in documents by canonical digests (operator 7), with DataFrame and SQL functions only.

A text is made canonical: A-Z lower-cased, copyright lines left out, everything but letters and digits turned into single
spaces, and equivalent spellings made one. Copyright lines are statements and rights notices, not body lines that go on about copyright. The
SHA-256 of the whole document, and that of each of its lines, is joined with the digests of known licence texts and notices, which are made
canonical by the same expression. Only entire texts match: a licence with a changed word has another digest. Documents of any length are
taken whole.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratapanel.llm import store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lines left out as copyright statements: not lines of a body, as wrapping may leave them, that go on about copyright ("copyright notice, this
#: list", "COPYRIGHT HOLDERS AND") without a year, nor its items "(c) You must".
ABOUT = (
    r"s?[ \t,;]+(?:notices?|holders?|owners?|licen[cs]e[sd]?|laws?|statements?|protection|interests?|treat(?:y|ies)|permission|and|or|on"
    r"|in|is|to|for|patent|trademark|doctrines?|rights?|disclaimers?|status|resulting|control)\b"
)
ITEM = r"\(c\)[ \t]*(?:you|the|if|any|an?|to|in|third|for|is|it|under|representations)\b"
STATEMENT = (
    rf"(?i)^[^a-z]*(?:©|all rights reserved|copyright(?!{ABOUT}(?!.*[0-9]{{4}}))(?!ed|able|[.,;\"](?!.*[0-9]{{4}}))|(?!{ITEM})\(c\))"
)
#: The statement that is a notice of its own where it stands alone on a line.
RIGHTS = "all rights reserved"
SEPARATORS = "[^A-Za-z0-9]+"
#: What a text must contain for the pattern to match ("" for a digit), the pattern over its words, and the spelling used for it.
SPELLINGS = (
    ("licen", r"\blicence", "license"), ("sub licen", r"\bsub license", "sublicense"), ("non infringement", r"\bnon infringement\b", "noninfringement"),
    ("organisation", r"\borganisation", "organization"), ("whilst", r"\bwhilst\b", "while"), ("favour", r"\bfavour", "favor"),
    ("https", r"\bhttps\b", "http"), ("", r"\bv ?(\d)", "version $1"),
)

AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
BSD_ONE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
BSD_TWO = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
BSD_THREE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'

#: Licence identifier and text.
KNOWN: tuple[tuple[str, str], ...] = (
    ("MIT", MIT),
    ("MIT", "MIT License " + MIT),
    ("MIT", "The MIT License (MIT) " + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + AS_IS),
    ("BSD-2-Clause", BSD_HEAD + BSD_ONE + BSD_TWO + BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD_HEAD + BSD_ONE + BSD_TWO + BSD_THREE + BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "This project is licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Digests of whole texts as published (those of /usr/share/common-licenses on Debian): with and without the appendix where there is one.
FULL: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6"),
    ("Apache-2.0", "f9138026e58bdb767e6c6e974637ff9aacbaedf2695e30fef144e5d7d84448ff"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0", "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6"),
    ("MPL-2.0", "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
)
#: Words of which each text of FULL contains one.
FULL_MARKS = ("distinguishing", "merchantability")
RIGHTS_NAME, RIGHTS_MARK = "All-Rights-Reserved", "reserved"


def bare(text: Column) -> Column:
    """ASCII letters and digits, lower-cased, with single spaces between."""
    return F.lower(F.trim(F.regexp_replace(text, SEPARATORS, " ")))


def without_copyright(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(STATEMENT)), " ")


def with_digest(units: DataFrame) -> DataFrame:
    """`words` (bare) gives way to the digest of its canonical form; plain searches tell whether any spelling is to be changed."""
    words = F.col("words")
    spelled, wanted = words, F.lit(False)
    for hint, pattern, spelling in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, spelling)
        wanted = wanted | (words.contains(hint) if hint else words.rlike("[0-9]") & words.rlike(pattern))
    # never null, so that the join has no filter that works all of this out once more
    digest = F.coalesce(F.sha2(F.when(wanted, spelled).otherwise(words), 256), F.lit(""))
    return units.withColumn("digest", digest).drop("words")


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...], full: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """license, digest: one row for each; the table is as small as the given lists."""
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in known]))
    rows = spark.range(1).select(rows.alias("x")).select("x.license", bare(without_copyright(F.col("x.text"))).alias("words"))
    rows = with_digest(rows.filter("words <> ''"))
    rights = F.lit(RIGHTS_NAME).alias("license"), F.sha2(F.lit(RIGHTS), 256).alias("digest")
    rows = rows.union(spark.range(1).select(*rights))
    if full:
        given = F.explode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(digest).alias("digest")) for name, digest in full]))
        rows = rows.union(spark.range(1).select(given.alias("x")).select("x.license", "x.digest"))
    return rows.distinct()


def marks(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> list[str]:
    """Words of which every text that matches contains one, in some case: of each known text the longest that no spelling touches."""
    given = F.explode(F.array(*[F.lit(text) for _, text in known]))
    texts = spark.range(1).select(given.alias("text")).select(bare(without_copyright(F.col("text")))).collect()  # as many as were given
    touched = re.compile("licen|infring|organi|whil|favo|http|version|^v?[0-9]")
    return sorted({max((w for w in text.split() if not touched.search(w)), key=lambda w: (len(w), w), default="") for (text,) in texts if text})


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = KNOWN, full: tuple[tuple[str, str], ...] = FULL) -> DataFrame:
    """A row for each doc_id, licence and scope that match: doc_id, license, scope ("text" or "line"), n_matches.

    A text of one line counts as a text and as a line. "All rights reserved" alone on a line is a notice, though the line is left out of the
    digest of the whole text as a statement. Null, empty and letterless texts match nothing. Rows that share a doc_id,
    or have none, are counted together. Other columns are ignored; an empty table gives an empty result.

    Only texts and lines that hold a word of some known text are made canonical, as no other can match.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = sorted({*marks(docs.sparkSession, known), RIGHTS_MARK, *(FULL_MARKS if full else ())})

    def may_match(column: str) -> Column:
        return reduce(lambda a, b: a | b, [F.lower(column).contains(w) for w in words], F.lit(False))

    base = base.filter(may_match("text"))
    whole = base.select("doc_id", F.lit("text").alias("scope"), bare(without_copyright(F.col("text"))).alias("words"))
    lines = base.select("doc_id", F.lit("line").alias("scope"), F.explode(F.split("text", "\n")).alias("line")).filter(may_match("line"))
    lines = lines.select("doc_id", "scope", F.col("line").rlike(STATEMENT).alias("stated"), bare(F.col("line")).alias("words"))
    lines = lines.filter(~F.col("stated") | (F.col("words") == RIGHTS)).drop("stated")
    units = with_digest(whole.union(lines))
    return units.join(known_digests(docs.sparkSession, known, full), "digest").groupBy("doc_id", "license", "scope").agg(F.count("*").alias("n_matches"))


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(store.table(spark, sf_dir, "documents"))


def oracle() -> str:
    """SQL of the same, its patterns without looking ahead: what must not follow is asked for on its own."""
    head, year = "regexp_matches(l, '^[^a-z]*", ".*[0-9]{4}"
    dated = [f"{head}copyright{after}') and not {head}copyright{after}{year}')" for after in (ABOUT, '[.,;"]')]
    statement = (
        f"({head}(©|all rights reserved)') or {head}copyright') and not ({dated[0]}) and not ({dated[1]}) and not {head}copyright(ed|able)')"
        f" or {head}[(]c[)]') and not {head}{ITEM}'))"
    )
    bared = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
    spelled = bared.format(f"array_to_string(list_filter(string_split(x, chr(10)), lambda l: not {statement}), ' ')")
    for _, pattern, spelling in SPELLINGS:
        spelled = f"regexp_replace({spelled}, '{pattern}', '{spelling.replace('$1', chr(92) + '1')}', 'g')"
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in KNOWN)
    digests = ", ".join(f"('{n}', '{d}')" for n, d in FULL)
    fold = f"translate({{}}, '{UPPER}', '{LOWER}')"
    return f"""
with known as (
    select license, sha256({spelled}) as digest from (select license, {fold.format('t')} as x from (values {values}) k(license, t))
    union select * from (values {digests}) f(license, digest)
    union select '{RIGHTS_NAME}', sha256('{RIGHTS}')
),
folded as (select doc_id, {fold.format("coalesce(text, '')")} as f from documents),
units as (
    select doc_id, 'text' as scope, f as x from folded
    union all select doc_id, 'line' as scope, unnest(string_split(f, chr(10))) as x from folded
),
digests as (
    select doc_id, scope, sha256(c) as digest
    from (select doc_id, scope, case when scope = 'line' and {bared.format('x')} = '{RIGHTS}' then '{RIGHTS}' else {spelled} end as c from units) where c <> ''
)
select doc_id, license, scope, count(*) as n_matches from digests join known using (digest) group by doc_id, license, scope
"""
