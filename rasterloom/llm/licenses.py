"""License scans by canonical digest lookup, DataFrame operations only.

A text is brought to a canonical form (lower case A-Z, copyright lines removed, also
behind the marks of a comment, every run of punctuation, typographic punctuation
included, and white space one blank, equivalent spellings unified), and the digest of the
entire form is joined to the digests of known licences. For that lookup lines that only
give a short licence's title or reserve all rights go, too. Lines that are notices of a
licence on their own are looked up the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

# Public licence texts and one-line notices, by identifier.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN
AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form
or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to
the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in
perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org/>""",
}
NOTICES = {
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
}
#: Identifier by digest of the canonical form of further whole texts, made from the published files.
DIGESTS: dict[str, str] = {
    "6ab5deeb4b2c14f4681b97d03ec0d6cf046968b552bd6e2efe1721910b2e5e9e": "Apache-2.0",
    "b7bb6b2416cb5fc4e3acd34d1283c66e6228adab995f1c959405a3978193462c": "Apache-2.0",
    "cf7c26411074d941b42afe8baac32788531f003acea32d25ead49048c329c78d": "Apache-2.0",
    "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224": "GPL-1.0",
    "b866f5427b78991db8012466b32f51c907f5e974fde5129a47372d0d0552e3a1": "GPL-2.0",
    "f3ab5ee40da170411ea6671f9845ada2aaba303ee57ba6086b373d1e66c9dc3f": "GPL-3.0",
    "9b0b3105b96203f9d9e4b72d4b77951152156c88139302b5aedf6295e3ceaaa3": "LGPL-2.0",
    "cb225061bb71741fe8b31a2092e22fe05b1130438158ae5d16c48fd50186e345": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354": "MPL-1.1",
    "95f6a0d094cf3da6a140310541c7b576789031b600469b70877b34f97918e4c9": "MPL-2.0",
    "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e": "CC0-1.0",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "2e61de4384356a713d509cc8bcf9659632a66ac1bd12bc3f9c7a46c1d6d85cac": "BSD-3-Clause",
    "d047e3d622526e339bf42277d2adb7fb932ad2e26e162bad5254b96ff6aeacde": "BSD-3-Clause",
    "a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30": "BSD-2-Clause",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7": "Zlib",
}
#: Equivalent spellings, British or split on the left; applied to the canonical form.
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non infringement", "noninfringement"),
             ("non commercial", "noncommercial"), ("merchantibility", "merchantability"), ("organisation", "organization")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAD = r"[ \t#/*;%!<>=.|-]*"  # marks of a comment before a line's text
COPYRIGHT = r"(^|\n)" + LEAD + r"(?:copyright|\(c\)|©)[^\n]*"
_NAME = (r"(?:(?:bsd )?zero[- ]clause(?: bsd)?|(?:new |revised |modified |simplified )bsd|[23][- ]clause bsd|"
         r"bsd[ -][023][ -]clause(?: \"(?:simplified|new)\"(?: or \"(?:freebsd|revised)\")?)?|mit|expat|isc|zlib|0bsd|bsd)")
TITLE = LEAD + r"(?:(?:the )?" + _NAME + r" licen[sc]e(?: ?\([^()\n]{1,20}\))?|(?:the )?unlicense|all rights reserved)[ \t\r.:*/#-]*"
#: Copyright lines, and lines that only give a short licence's title or reserve all rights.
HEAD = r"(^|\n)(?:" + LEAD + r"(?:copyright|\(c\)|©)[^\n]*|" + TITLE + r"(?=\n|$))"
#: White space, ASCII punctuation, and typographic blanks, hyphens, dashes, quotes, dots and ellipsis.
MARKS = r"[\x00-\x20!-/:-@\[-`{-~" + "\u00a0\u00ab\u00b7\u00bb\u2010-\u201f\u2022\u2026\u202f" + "]+"


def canonical(text: Column, head: str = HEAD) -> Column:
    """Canonical form of a text, without the lines that ``head`` fits; single lines keep their title."""
    t = F.translate(whole(text), UPPER, LOWER)
    t = F.regexp_replace(t, head, "\n")
    t = F.trim(F.regexp_replace(t, MARKS, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def _plain(text: str, head: str = HEAD) -> str:
    """The same form of a known text, whose letters are ASCII."""
    import re

    t = " ".join(re.split(MARKS, re.sub(head, "\n", text.lower()))).strip()
    for a, b in SPELLINGS:
        t = t.replace(a, b)
    return t


def known(texts: dict[str, str], head: str = HEAD) -> dict[str, str]:
    """Identifier by digest; a text without a word is none."""
    import hashlib

    forms = {i: _plain(t, head) for i, t in texts.items()}
    return {hashlib.sha256(t.encode()).hexdigest(): i for i, t in forms.items() if t}


def _may_say(line: Column, notices: dict[str, str]) -> Column:
    """Whether a lower-cased line holds all the words of a notice that no spelling touches: a canonical
    form's words stand in its line as they are, so no line that says a notice is left out."""
    may = F.lit(False)
    for form in {_plain(x, COPYRIGHT) for x in notices.values()}:
        words = {w for w in form.split() if not any(b in w for _, b in SPELLINGS)}
        has = F.lit(bool(form))
        for w in sorted(words, key=lambda w: (-len(w), w)):
            has = has & line.contains(w)
        may = may | has
    return may


def scan(docs: DataFrame, texts: dict[str, str] = LICENSES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row per document: ``doc_id``, ``digest`` of its canonical form (with title lines), ``license``
    (identifier if the entire text is a known licence, with or without such lines, else null), ``n_notices`` (lines that are a known
    notice) and ``notices`` (their identifiers, distinct and sorted, comma-separated).

    ``DIGESTS`` count as known, too, unless other texts are given. The known digests are a table of as many rows as licences are given, so it is
    broadcast. Null texts count as empty, and match nothing; texts of any length count as a
    whole; doc_id is passed through, null or repeated; other columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    table = known({**texts}) | (DIGESTS if texts is LICENSES else {})
    table = spark.createDataFrame(list(table.items()), "lookup string, license string")
    text = F.col("text").cast("string")
    low = F.translate(whole(text), UPPER, LOWER)
    lines = F.filter(F.split(low, "\n"), lambda x: _may_say(x, notices))
    said = F.transform(lines, lambda x: F.sha2(canonical(x, COPYRIGHT), 256))
    of = known(notices, COPYRIGHT)
    ids = F.array().cast("array<string>")
    if of:
        ids = F.filter(F.transform(said, lambda h: F.element_at(F.create_map(*[F.lit(v) for kv in of.items() for v in kv]), h)), lambda x: x.isNotNull())
    d = docs.select("doc_id", "text", F.sha2(canonical(text, COPYRIGHT), 256).alias("digest"), ids.alias("ids"))
    titled = low.contains("licen") | low.contains("all rights reserved")  # words of every title; else both forms are the same
    d = d.withColumn("lookup", F.when(titled, F.sha2(canonical(text), 256)).otherwise(F.col("digest"))).drop("text")
    return (d.join(F.broadcast(table), "lookup", "left")
            .select("doc_id", "digest", "license", F.size("ids").cast("long").alias("n_notices"),
                    F.array_join(F.array_sort(F.array_distinct("ids")), ",").alias("notices")))


def _sql_form(low: str) -> str:
    """The form of a lower-cased text without its lines that do not count."""
    t = f"trim(regexp_replace({low}, '{MARKS}', ' ', 'g'), ' ')"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


def _sql_lines(*patterns: str) -> str:
    keep = " AND ".join(f"NOT regexp_matches(x, '^(?:{p})')" for p in patterns)
    return f"array_to_string(list_filter(string_split(low, chr(10)), lambda x: {keep}), chr(10))"


def _values(digests: dict[str, str]) -> str:
    return ", ".join(f"('{h}', '{i}')" for h, i in digests.items())


_RIGHT = LEAD + r"(?:copyright|\(c\)|©)"
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
d AS (SELECT k, doc_id, sha256({_sql_form(_sql_lines(_RIGHT))}) AS digest, sha256({_sql_form(_sql_lines(_RIGHT, TITLE + '$'))}) AS lookup FROM t),
l AS (
  SELECT k, sha256({_sql_form('line')}) AS h FROM (SELECT k, unnest(string_split(low, chr(10))) AS line FROM t)
  WHERE NOT regexp_matches(line, '^(?:{_RIGHT})')),
n AS (SELECT k, count(*) AS n_notices, string_agg(DISTINCT id, ',' ORDER BY id) AS notices
  FROM l JOIN (VALUES {_values(known(NOTICES, COPYRIGHT))}) v(h, id) USING (h) GROUP BY k)
SELECT doc_id, digest, id AS license, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN n USING (k) LEFT JOIN (VALUES {_values(known(LICENSES) | DIGESTS)}) w(h, id) ON h = lookup
"""
