"""License scans: Dice coefficient with templates. DataFrame functions only."""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .common import Docs, let

SIMILAR = 0.8

# Notices and short texts of public licences.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."),
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions: The above copyright notice and this permission notice shall be included in all "
        'copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY '
        "KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF "
        "OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
        "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, "
        "DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-line": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "lgpl-2.1-notice": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version. This library is distributed in the hope that it will be useful, but "
        "WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU Lesser General Public License for more details."),
    "agpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
        "your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See "
        "the GNU Affero General Public License for more details."),
    "mpl-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
        'other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
        'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
        "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
        "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
        "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF "
        "THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "bsd-3-clause-line": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
        "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
        "this software for any purpose, including commercial applications, and to alter it and redistribute it "
        "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
        "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. "
        "This notice may not be removed or altered from any source distribution."),
    "bsl-1.0-notice": (
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
        "http://www.boost.org/LICENSE_1_0.txt)"),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize "
        "copyright laws, the author or authors of this software dedicate any and all copyright interest in the "
        "software to the public domain. We make this dedication for the benefit of the public at large and to the "
        "detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in "
        "perpetuity of all present and future rights to this software under copyright law."),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scanned(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, similar: float = SIMILAR,
    id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Where documents hold words near one of the templates, on whatever lines.

    Texts are normalised to runs of ASCII letters and digits, A-Z in lower case. The
    Dice coefficient of words and a template is twice the number of word bigrams both have,
    over the sum of the numbers each has; repeats within one count once. At
    `similar` or more they match. With b bigrams in the template, words with
    fewer than similar * b / (2 - similar) of them cannot match; so of any words that do, one is
    among the anchors: as many of the template's bigrams as may be missing and one, the
    rarest in the documents. Wherever an anchor stands, the words that lie around it as the
    template's do are a window, from the first of the template's bigrams in it to the last.
    Windows with too few of these go before their other words are looked at.

    Returns kid, kt, template, first, last (numbers of words, from 1), dice: a row for every
    different window that matches; windows of one place may overlap. Null and empty texts,
    texts and templates of fewer than two words match nothing. Rows that repeat id and text are one
    document. An empty table gives no rows. The templates are constants of the
    caller's, and broadcast. A long text is searched in blocks of a template's length.
    """
    table = Docs(docs, id, text)
    known, placed = _templates(docs, templates, similar)
    pairs = table.slim(F.posexplode(bigrams(F.col("text"))).alias("p", "bigram")).withColumn("p", F.col("p") + 1)
    hits = written(pairs.join(F.broadcast(placed.select("bigram").distinct()), "bigram"))

    counts = hits.groupBy("bigram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("template").orderBy(F.coalesce("n", F.lit(0)), "bigram"))
    own = placed.select("template", "bigram").distinct()
    anchors = own.join(counts, "bigram", "left").withColumn("rank", rank).join(known, "template").where(F.col("rank") <= F.col("anchors"))
    at = anchors.select("template", "bigram", "length").join(placed, ["template", "bigram"])
    starts = hits.join(F.broadcast(at), "bigram").select(
        "kid", "kt", "template", "length", (F.col("p") - F.col("offset")).alias("start")).distinct()
    # The bigrams of a window lie in the block of its start and the next one.
    block = F.floor(F.col("start") / F.col("length"))
    searched = starts.select("*", F.explode(F.array(block, block + 1)).alias("block"))
    found = hits.join(F.broadcast(own.join(known, "template")), "bigram").select(
        "kid", "kt", "template", "p", "bigram", "need", "b", F.floor(F.col("p") / F.col("length")).alias("block"))
    inside = F.col("p").between(F.col("start"), F.col("start") + F.col("length") - 2)
    windows = searched.join(found, ["kid", "kt", "template", "block"]).where(inside).groupBy(
        "kid", "kt", "template", "start", "need", "b").agg(
        F.count_distinct("bigram").alias("common"), F.min("p").alias("first"), F.max("p").alias("last"))
    likely = windows.where(F.col("common") >= F.col("need")).select("kid", "kt", F.struct(
        "template", "first", "last", "common", "b").alias("x"))
    each = likely.groupBy("kid", "kt").agg(F.collect_set("x").alias("all"))

    def measured(all_: Column) -> Column:
        return F.transform("all", lambda x: F.struct(x["template"].alias("template"), x["first"].alias("first"), (x["last"] + 1).alias("last"), (
            2.0 * x["common"] / (F.size(F.array_distinct(F.slice(all_, x["first"], x["last"] - x["first"] + 1))) + x["b"])).alias("dice")))

    texts = table.slim("text").join(each, ["kid", "kt"])
    done = texts.select("kid", "kt", F.explode(let(bigrams(F.col("text")), measured)).alias("x"))
    # Repeated rows give the same windows again.
    return done.select("kid", "kt", "x.*").where(F.col("dice") >= similar).distinct()


def _templates(docs: DataFrame, templates: dict[str, str], similar: float) -> tuple[DataFrame, DataFrame]:
    """Per template its words, its different bigrams b, how many of them a match needs and how many are
    anchors; and the places of its bigrams, offset counting from 0."""
    given = docs.sparkSession.createDataFrame(sorted(templates.items()), "template string, text string")
    all_ = given.select("template", bigrams(F.col("text")).alias("all")).where(F.size("all") > 0)
    sizes = {r["b"]: _need(r["b"], similar) for r in all_.select(F.size(F.array_distinct("all")).alias("b")).collect()}
    need = F.create_map(*[F.lit(x) for pair in (sizes or {0: 0}).items() for x in pair])
    known = all_.select("template", (F.size("all") + 1).alias("length"), F.size(F.array_distinct("all")).alias("b")).withColumn(
        "need", need[F.col("b")]).withColumn("anchors", F.col("b") - F.col("need") + 1)
    return known, all_.select("template", F.posexplode("all").alias("offset", "bigram"))


def _need(b: int, similar: float) -> int:
    return ceil(similar * b / (2 - similar) - 1e-9)


def bigrams(text: Column) -> Column:
    """The pairs of neighbouring words of the normalised text, in order."""
    words = F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit("[a-z0-9]+"), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) > 1, F.zip_with(
        F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat(x, F.lit(" "), y),
    )).otherwise(F.array().cast("array<string>")))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_matches (templates found), and of the best match (ties: the first
    place, the shortest, then the first template by name) license, dice, first_word, last_word."""
    table = Docs(docs)
    ranked = scanned(docs).groupBy("kid", "kt").agg(
        F.count_distinct("template").alias("n_matches"), F.max("dice").alias("dice"),
        F.min(F.struct((-F.col("dice")).alias("d"), "first", "last", "template")).alias("best"))
    return table.slim("id").join(ranked, ["kid", "kt"], "left").select(
        F.col("id").alias("doc_id"), F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches"),
        F.col("best.template").alias("license"), F.col("dice"), F.col("best.first").cast("bigint").alias("first_word"),
        F.col("best.last").cast("bigint").alias("last_word"))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in sorted(TEMPLATES.items()))
    words = f"regexp_extract_all(translate({{}}, '{UPPER}', '{LOWER}'), '[a-z0-9]+')"
    # The least whole number that is no less than similar * b / (2 - similar) = 2 b / 3.
    need = "(2 * b + 2) // 3"

    def pairs(key: str, source: str, at: str, first: int) -> str:
        return (f"SELECT {key}, unnest(range({first}, len(w) - 1 + {first})) AS {at}, unnest(list_transform("
                f"list_zip(w[1:len(w) - 1], w[2:]), lambda x: x[1] || ' ' || x[2])) AS bigram FROM {source} WHERE len(w) > 1")

    return f"""
WITH given(template, text) AS (VALUES {values}),
held AS MATERIALIZED (SELECT template, {words.format('text')} AS w FROM given),
placed AS MATERIALIZED ({pairs('template', 'held', 'o', 0)}),
own AS MATERIALIZED (SELECT DISTINCT template, bigram FROM placed),
known AS (SELECT template, count(*) AS b, (SELECT len(w) FROM held h WHERE h.template = own.template) AS len FROM own GROUP BY template),
worded AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
pairs AS MATERIALIZED ({pairs('doc_id', 'worded', 'p', 1)}),
hits AS MATERIALIZED (SELECT * FROM pairs WHERE bigram IN (SELECT bigram FROM own)),
rare AS (SELECT bigram, count(*) AS n FROM hits GROUP BY bigram),
ordered AS (SELECT template, bigram, row_number() OVER (PARTITION BY template ORDER BY coalesce(n, 0), bigram) AS r
  FROM own LEFT JOIN rare USING (bigram)),
anchors AS (SELECT template, bigram, len FROM ordered JOIN known USING (template) WHERE r <= b - {need} + 1),
starts AS (SELECT DISTINCT doc_id, template, len, p - o AS s FROM hits JOIN anchors USING (bigram) JOIN placed USING (template, bigram)),
found AS (SELECT doc_id, template, p, bigram FROM hits JOIN own USING (bigram)),
windows AS (SELECT s.doc_id, s.template, s.s, count(DISTINCT bigram) AS common, min(p) AS first, max(p) AS last
  FROM starts s JOIN found f ON s.doc_id = f.doc_id AND s.template = f.template AND p BETWEEN s.s AND s.s + s.len - 2 GROUP BY ALL),
likely AS (SELECT DISTINCT doc_id, template, first, last, common, b FROM windows JOIN known USING (template) WHERE common >= {need}),
sized AS (SELECT l.doc_id, template, first, last, common, b, count(DISTINCT bigram) AS a
  FROM likely l JOIN pairs x ON l.doc_id = x.doc_id AND x.p BETWEEN first AND last GROUP BY ALL),
matched AS (SELECT doc_id, template, first, last + 1 AS last, 2.0::DOUBLE * common / (a + b) AS dice FROM sized
  WHERE 2.0::DOUBLE * common / (a + b) >= {SIMILAR}),
counted AS (SELECT doc_id, count(DISTINCT template) AS n_matches FROM matched GROUP BY doc_id),
best AS (SELECT * FROM matched QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, first, last, template) = 1)
SELECT doc_id, coalesce(n_matches, 0) AS n_matches, template AS license, dice, first::BIGINT AS first_word, last::BIGINT AS last_word
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN counted USING (doc_id)"""


ORACLE_SQL = _oracle()
