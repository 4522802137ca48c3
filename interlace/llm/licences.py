"""Licence scan by canonical digest: whole texts against known licences.

A text is normalised (case, copyright notices, punctuation, equivalent spellings, title lines), digested, and hash-joined
with the digests of the known licences, which are normalised by the same expressions. Built-in functions only.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

# Spellings that the licence matching guidelines treat as equal (from, to).
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "acknowledgement": "acknowledgment", "analogue": "analog",
    "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorised": "authorized", "favour": "favor",
    "fulfil": "fulfill", "judgement": "judgment", "merchantibility": "merchantability", "organisation": "organization",
    "recognised": "recognized", "whilst": "while", "wilful": "willful", "https": "http",
}
PAIRS = {"sub license": "sublicense", "non infringement": "noninfringement", "copyright owner": "copyright holder", "copyright owners": "copyright holders"}

# Places of the normal form where the matching guidelines allow any names, and what is put there instead.
NAMES = {
    "neither the name of .{1,200}? nor the names of its contributors": "neither the name of the copyright holder nor the names of its contributors",
    "this software is provided by .{1,200}? as is and any express or implied warranties": "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    "in no event shall .{1,200}? be liable for any direct indirect incidental": "in no event shall the copyright holder or contributors be liable for any direct indirect incidental",
}
# Texts of public licences and of the notices that stand for them.
_PERMIT = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
    "materials provided with the distribution.\n\n"
)
_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission.\n\n"
)
_DISCLAIM = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: How the items of a list may be marked; bullets are punctuation, as is a dot or bracket after a number or letter.
MARKS = ("{n}. ", "* ", "{letter}) ")
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     'associated documentation files (the "Software"), to deal in the Software without restriction, including without '
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
     'substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS '
     "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
     "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
     "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
     "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n"
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
     "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
     "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
     "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
     "USE OR PERFORMANCE OF THIS SOFTWARE."),
    *((name, reduce(lambda t, n: t.replace(f"{n}. ", mark.format(n=n, letter="abc"[n - 1])), (1, 2, 3), body + _DISCLAIM)) for name, body in (("BSD-2-Clause", _PERMIT), ("BSD-3-Clause", _PERMIT + _THIRD)) for mark in MARKS),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: The digest of an empty normal form.
EMPTY = hashlib.sha256(b"").hexdigest()
# Digests of the normal forms of longer public licences, whole texts as the licences' stewards publish them.
DIGESTS = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2-only": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3-only": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0-only": "e80b630fa4f92f7da9cffbd75699f62bfac51ce5b33da44e74b5acc53e5187f6",
    "GPL-2.0-only": "ada43b21b16dd64b4b8f1d9c2ab43ff16f75a8f0f835fc2f37a0c7e65f28d243",
    "GPL-3.0-only": "274362af652e77e6f0b95849b862c8080691fdb958ffa1c562be7710f3ee74db",
    "LGPL-2.0-only": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1-only": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0-only": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "d8d0b06e50958b0eba5a23fe34f89208823600494dec35f53d75d38796963973",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}

#: A copyright notice: from the claim to the line's end, or to words with which the text of a licence goes on after it.
COPYRIGHT = (
    r"(?:(?:^|\n)[ \t*#/;%-]*copyright +[^\n]*?|(?:copyright *(?:\(c\)|©)|copyright +[0-9]|\(c\) +[0-9]|© *[0-9]|all rights reserved)[^\n]*?)"
    r"(\n|$|\bpermission |\bredistribution |\blicen[sc]ed |\breleased |\bthis |\bthe software )"
)
#: "copyright" in the running text of a licence, which may begin a line there; it is kept from COPYRIGHT.
RUNNING = r"\bcopyright( +(?:notices?|holders?|owners?|licen[sc]es?|statement|law|interest|and|or|to|in|is))\b"
#: Titles that stand before the text of some licences and are left out in copies of others.
TITLE = r"^(the )?(mit|isc|(new |simplified |modified )?bsd( [0-9] clause)?) license( mit)? "


def canonical(text: Column) -> Column:
    """The normal form: lower case, no copyright notices or title, words and digits between single spaces, one spelling, and
    one name where any may stand.

    Only the notice goes, not what follows it on its line. A notice without year or sign counts if it begins a line.
    """
    text = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), RUNNING, "copyright:$1")
    # Two line breaks, so that neighbouring notices do not share one.
    text = F.regexp_replace(F.replace(text, F.lit("\n"), F.lit("\n\n")), COPYRIGHT, "\n$1")
    same = F.create_map(*[F.lit(x) for pair in EQUIVALENT.items() for x in pair])
    words = F.transform(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: F.coalesce(F.element_at(same, w), w))
    # Two blanks between words, so that neighbouring pairs do not share one.
    text = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    for old, new in PAIRS.items():
        text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    text = F.concat(F.trim(F.replace(text, F.lit("  "), F.lit(" "))), F.lit(" "))
    text = F.trim(F.regexp_replace(text, TITLE, ""))
    return reduce(lambda t, rule: F.regexp_replace(t, *rule), NAMES.items(), text)


def digests_of(known: DataFrame) -> DataFrame:
    """(digest, license_id) of a table of known licences (license_id, body); of equal texts the least id."""
    return known.groupBy(F.sha2(canonical(F.col("body")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def known_digests(spark: SparkSession) -> DataFrame:
    """The built-in list: the texts of KNOWN and the digests of DIGESTS."""
    texts = digests_of(spark.createDataFrame(list(KNOWN), "license_id string, body string"))
    return texts.unionByName(spark.createDataFrame([(d, i) for i, d in DIGESTS.items()], "digest string, license_id string"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(key, canonical_chars, digest, license_id) for every row of docs.

    known: a table (digest, license_id) with each digest once, of any size; the built-in list if not given. license_id is
    null where the whole text is no known licence. A null text counts as empty; an empty normal form matches nothing.
    Repeated rows and null keys are kept as they are; other columns are not read.
    """
    body = docs.select(F.col(key), canonical(text_of(text)).alias("body"))
    body = body.select(key, F.length("body").cast("long").alias("canonical_chars"), F.sha2(F.col("body"), 256).alias("digest"))
    # The built-in list has as many rows as the module; Spark decides by its size about a given table.
    found = F.broadcast(known_digests(docs.sparkSession)) if known is None else known.select("digest", "license_id")
    found = found.filter(F.col("digest") != F.lit(EMPTY))
    return body.join(found, "digest", "left").select(key, "canonical_chars", "digest", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    x = f"regexp_replace(replace(lower({x}), '&', ' and '), '{RUNNING}', 'copyright:\\1', 'g')"
    x = f"regexp_replace(replace({x}, chr(10), chr(10) || chr(10)), '{COPYRIGHT}', chr(10) || '\\1', 'g')"
    same = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in EQUIVALENT.items()) + "}"
    x = f"array_to_string(list_transform(regexp_split_to_array({x}, '[^\\p{{L}}\\p{{N}}]+'), lambda w: coalesce({same}[w], w)), '  ')"
    x = f"' ' || {x} || ' '"
    for old, new in PAIRS.items():
        x = f"replace({x}, ' {old.replace(' ', '  ')} ', ' {new.replace(' ', '  ')} ')"
    x = f"trim(regexp_replace(trim(replace({x}, '  ', ' '), ' ') || ' ', '{TITLE}', ''), ' ')"
    return reduce(lambda t, rule: f"regexp_replace({t}, '{rule[0]}', '{rule[1]}', 'g')", NAMES.items(), x)


_ROWS = ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in KNOWN)
_DIGESTS = ", ".join(f"('{d}', '{i}')" for i, d in DIGESTS.items())
SQL = f"""
WITH known AS (SELECT sha256({_sql_canonical("body")}) AS digest, min(license_id) AS license_id
               FROM (VALUES {_ROWS}) AS t(license_id, body) GROUP BY 1 UNION ALL SELECT * FROM (VALUES {_DIGESTS}) AS t(digest, license_id)),
d AS (SELECT doc_id, {_sql_canonical("coalesce(text, '')")} AS body FROM documents),
e AS (SELECT doc_id, CAST(length(body) AS BIGINT) AS canonical_chars, sha256(body) AS digest FROM d)
SELECT doc_id, canonical_chars, digest, license_id FROM e LEFT JOIN known USING (digest)
"""
