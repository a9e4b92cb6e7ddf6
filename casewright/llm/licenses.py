r"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to canonical form (lower case; copyright, title and "all rights reserved" lines out; equivalent spellings joined, punctuation and
white space reduced to single spaces) and its SHA-256 is looked up among the digests of known licence texts and
notices. The whole text and, in texts that name a licence, every run of lines that starts with a known text's first word
and has as many words are looked up, so wrapped notices and licences within a text are found. The lookup is one hash join with
a table of known digests, whose size is fixed by this module and the whole texts in license_texts.

Defined cases: null text is empty; a text without letters or digits has the digest of the empty string and no
licence; very long texts are hashed whole; rows that repeat doc_id and text are one document and get equal rows; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_of

#: Fixed values: (licence, text). Notices are single lines; whole licences have no copyright line.
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _AS_IS),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. " + _ISC_AS_IS),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC_AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD3 + _BSD_AS_IS),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Licensed under the 3-Clause BSD License."),
)
#: Creative Commons licences, short and long names, by version; and names of others, each after every lead.
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_LEADS = [f"{who}{how} under {the}" for who in ("", "This work is ", "This project is ", "This file is ") for how in ("licensed", "released") for the in ("", "a ", "the ")]


def _named():
    names = [("CC0-1.0", n) for n in ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero 1.0 Universal")]
    for code, name in _CC.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            port = "International" if v == "4.0" else "Unported"
            for stem in (f"CC {code} {v}", f"Creative Commons {code} {v}", *(f"Creative Commons {n} {v}{end}" for n in {name, name.replace("NoDerivatives", "NoDerivs")} for end in ("", f" {port}"))):
                names += [(f"CC-{code}-{v}", stem), (f"CC-{code}-{v}", f"{stem} License")]
    for code, text in (("MIT", "MIT License"), ("ISC", "ISC License"), ("BSD-2-Clause", "2-Clause BSD License"), ("BSD-3-Clause", "3-Clause BSD License"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License 2.0"), ("MPL-2.0", "Mozilla Public License 2.0"), ("MPL-2.0", "Mozilla Public License, version 2.0"),
                       *((f"{k}-{v}", f"GNU {n}General Public License, version {v[:-2] if v.endswith('.0') else v}") for k, n, vs in (("GPL", "", ("2.0", "3.0")), ("LGPL", "Lesser ", ("2.1", "3.0")), ("AGPL", "Affero ", ("3.0",))) for v in vs)):
        names.append((code, text))
    for code, name in names:
        yield from ((code, lead + name) for lead in _LEADS)
        if code.startswith("CC"):
            yield code, name


@cache
def texts() -> tuple:
    """(licence, text): KNOWN, the named licences, and the whole texts."""
    return (*KNOWN, *_named(), *((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))))


#: Spellings that count as one (pattern, canonical form), applied to text in lower case.
SPELLINGS = ((r"licence", "license"), (r"licens(ed|ing)\b", "license"), (r"\bfavour", "favor"), (r"\bauthoris", "authoriz"), (r"\bmerchantibility", "merchantability"), (r"\bnon-infringement", "noninfringement"), (r"\bsub-licens", "sublicens"), (r"\bcopyright owner", "copyright holder"), (r"https:", "http:"), (r"&", " and "))
COPYRIGHT = r"(?m)^[^\n]{0,10}(?:copyright\b|\(c\)|©)[^\n]*\b[0-9]{4}\b[^\n]*$"
#: Copyright lines without a year or after other words; "all rights reserved"; titles. All are lines of their own.
DROPPED = (COPYRIGHT, r"(?m)^[^\n.;!?]*(?:copyright\s*(?:\(c\)|©)?|\(c\)|©)\s*[0-9]{4}\b[^\n]*$",
    r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\s*(?:\(c\)|©|:|by\b|the regents\b|the [^\n]{1,60} (?:authors|contributors|developers)\b)|\(c\)\s*(?:copyright\b|by\b)|©)[^\n]*$",
    r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$",
    r"(?m)^[^\p{L}\p{N}\n]*(?:the )?(?:mit|expat|isc|0bsd|zero-clause bsd|(?:new |modified |simplified |revised )?bsd|bsd[ -][0-9][ -]clause|[0-9][ -]clause bsd|apache|unlicense|gnu (?:lesser |library |affero )?general public|mozilla public)(?: licen[sc]e)?(?:,? version [0-9.]+| v?[0-9.]+)?(?: \([^)\n]{1,40}\))?[^\p{L}\p{N}\n]*$")
#: Lines are looked up in a text that names a licence.
NAMES = r"(?i)licen[sc]|permission|redistribut|copyright|creative commons|\bcc[ -]?(?:0|by)\b|public domain"


#: What a text in lower case must hold for a pattern of DROPPED, or of SPELLINGS, to match: looked for first, as searching
#: for a fixed string is far cheaper than running a pattern over every line.
HOLDS = (("copyright", "(c)", "©"), ("copyright", "(c)", "©"), ("copyright", "(c)", "©"), ("all rights reserved",),
    ("mit", "expat", "isc", "bsd", "apache", "unlicense", "general public", "mozilla public"))
HOLDS_SPELLING = ("licence", "licens", "favour", "authoris", "merchantibility", "non-infringement", "sub-licens", "copyright owner", "https:", "&")


def _if_holds(words, column: str, new: str) -> str:
    return f"CASE WHEN {' OR '.join(f"contains({column}, '{w}')" for w in words)} THEN {new} ELSE {column} END"


def canonical_sql(column: str) -> str:
    """Spark SQL for the canonical form of a string column. Each step is a lambda's variable, so that it is computed once."""
    out = f"array(lower({column}))"
    for pattern, words in zip(DROPPED, HOLDS):
        out = f"transform({out}, c -> {_if_holds(words, 'c', f"regexp_replace(c, r'{pattern}', '')")})"
    for (pattern, to), word in zip(SPELLINGS, HOLDS_SPELLING):
        out = f"transform({out}, c -> {_if_holds([word], 'c', f"regexp_replace(c, r'{pattern}', '{to}')")})"
    return f"trim(regexp_replace(element_at({out}, 1), r'[^\\p{{L}}\\p{{N}}]+', ' '))"


#: Lines whose words are counted together.
STRIDE = 64


def _runs_sql(lengths: dict[str, list[int]]) -> str:
    """Spark SQL: digests of the runs of lines of t whose first word and number of words are those of a known text."""
    by_word = "map(" + ", ".join(f"'{w}', array({', '.join(map(str, n))})" for w, n in sorted(lengths.items())) + ")"
    lines = f"filter(transform(split(t, '\\n'), x -> {canonical_sql('x')}), x -> x <> '')"
    # words before each line: sums of whole strides of lines, and of the lines since
    words = "transform(s.l, x -> size(split(x, ' ')))"
    marks = f"aggregate(sequence(0, size(w.n) div {STRIDE}), array(0), (a, k) -> array_append(a, element_at(a, -1) + aggregate(slice(w.n, k * {STRIDE} + 1, {STRIDE}), 0, (y, x) -> y + x)))"
    ends = f"transform(sequence(0, size(v.n)), k -> v.k[k div {STRIDE}] + aggregate(slice(v.n, (k div {STRIDE}) * {STRIDE} + 1, k % {STRIDE}), 0, (y, x) -> y + x))"
    starts = "filter(sequence(0, size(u.l) - 1), i -> map_contains_key(u.m, substring_index(u.l[i], ' ', 1)))"
    # a run of n words ends within n lines of its start, at one place at most
    hits = "filter(transform(u.m[substring_index(u.l[i], ' ', 1)], n -> i + int(nullif(array_position(slice(u.c, i + 2, n), u.c[i] + n), 0L))), j -> j IS NOT NULL)"
    runs = f"flatten(transform({starts}, i -> transform({hits}, j -> sha2(array_join(slice(u.l, i + 1, j - i), ' '), 256))))"
    some = f"filter(array(named_struct('l', {lines})), s -> size(s.l) > 0)"
    for step in (f"s -> named_struct('l', s.l, 'n', {words})", f"w -> named_struct('l', w.l, 'n', w.n, 'k', {marks})", f"v -> named_struct('l', v.l, 'c', {ends}, 'm', {by_word})", f"u -> {runs}"):
        some = f"transform({some}, {step})"
    some = f"flatten({some})"
    return f"CASE WHEN t RLIKE r'{NAMES}' THEN {some} ELSE cast(array() AS array<string>) END"


def known(spark: SparkSession) -> DataFrame:
    """digest, license: and the text itself, a row for each distinct canonical text."""
    rows = spark.createDataFrame(list(texts()), "license string, t string").select(F.expr(canonical_sql("t")).alias("t"), "license").where("t <> ''")
    return rows.select(F.sha2("t", 256).alias("digest"), F.split("t", " ")[0].alias("word"), F.size(F.split("t", " ")).alias("n"), "license").groupBy("digest", "word", "n").agg(F.min("license").alias("license"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest of the whole canonical text, its license or null, and notices: the licences
    named by runs of lines, sorted, once each."""
    df = docs.select("doc_id", text_of(docs).alias("t")).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "t")
    names, lengths = materialize(known(docs.sparkSession)), {}
    for r in names.select("word", "n").distinct().collect():
        lengths.setdefault(r.word, []).append(r.n)
    lines = F.expr(_runs_sql(lengths))
    rows = materialize(df.select("rid", "doc_id", F.sha2(F.expr(canonical_sql("t")), 256).alias("digest"), lines.alias("lines")))
    names = F.broadcast(names.select("digest", "license"))
    notices = rows.select("rid", F.explode(F.array_distinct("lines")).alias("digest")).join(names, "digest").groupBy("rid").agg(F.array_sort(F.collect_set("license")).alias("notices"))
    return rows.join(names, "digest", "left").join(notices, "rid", "left").select("doc_id", "digest", "license", F.coalesce("notices", F.expr("cast(array() AS array<string>)")).alias("notices"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))
