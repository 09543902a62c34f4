"""License scans: exact set-similarity join of text blocks with license templates (DataFrame functions only).

A block is a run of words, wherever lines end, so a notice that is wrapped, indented or in a comment is one like any other.
Templates are compared with blocks of their own length class: a template of up to c words (c a power of two) meets the
blocks of words [k c, k c + 2 c), k = 0, 1, ..., and any c words in a row lie in one of these as a whole. A block's token set
is compared with the template's: containment = shared distinct tokens / distinct tokens of the template. Every (block,
template) pair at or above the threshold is found, by the usual exact filters: tokens are put in one global order, rarest in
the corpus first; a template that shares `need` tokens with a block must share one of its first size - need + 1 (prefix
filter); a block with fewer than `need` template tokens can't match (length filter); and a first shared token at place i of
the template and j of the block leaves at most 1 + min(rest of template, rest of block) shared tokens (positional filter).
Survivors are counted in full.

Only tokens of the template vocabulary can ever be shared, so a block is reduced to these when it is read, which keeps
overlaps as they are and makes the length filter stronger. Texts are read twice, for the token order and for words, places
and blocks at once, and never shuffled: the statistics are one row per template token, and what is joined are blocks that
hold a prefix token, with the templates, which are the caller's list.

Nulls and empty texts count as texts without words. Words in repeated rows count each time; rows that share a doc_id are
told apart by their texts, and a null doc_id is a row of its own. Very long texts are split into blocks like others; no
block is left out. Ties can't arise: all labels are reported, and tokens of equal counts are ordered by spelling. An empty
table gives an empty result. Columns other than doc_id and text are ignored, whatever they are called.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import ascii_lower, materialize, table

#: Characters that are no part of a word.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose every place is reported, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
    "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices and license texts looked for by containment: the wording of public licenses, fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "all-rights-reserved": "All rights reserved",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _WARRANTY + " AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice "
    "appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is "
    "granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software "
    "must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "This notice may not be removed or altered from any source distribution.",
    "bsd-2-text": _BSD + _BSD_END,
    "bsd-3-text": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _BSD_END,
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
    "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
}


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null counts as empty."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def _split(text: str) -> list[str]:
    return [w for w in re.split(GAP, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def length_class(text: str) -> int:
    """The power of two that a template's number of words doesn't exceed."""
    return 1 << max(0, len(_split(text)) - 1).bit_length()


def template_tokens(templates: dict[str, str]) -> dict[str, list[str]]:
    return {label: found for label, text in templates.items() if (found := list(dict.fromkeys(_split(text))))}


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def token_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The template tokens, rarest first by the number of texts of the whole corpus that hold them, then by spelling."""
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), words(F.col("text")))).alias("token"))
    seen = {r["token"]: r["count"] for r in held.groupBy("token").count().collect()}  # a row per template token at most
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


def ranked_templates(templates: dict[str, str], order: list[str], threshold: float) -> list[tuple]:
    """(label, tokens in the global order, size, need, length class)."""
    rank = {w: k for k, w in enumerate(order)}
    return [
        (label, sorted(tokens, key=rank.__getitem__), len(tokens), math.ceil(round(threshold * len(tokens), 9)), length_class(templates[label]))
        for label, tokens in template_tokens(templates).items()
    ]


def blocks(held: Column, order: list[str], rows: list[tuple]) -> Column:
    """Of a text's words, the blocks that hold a prefix token: structs of length class, block number, and the distinct
    template tokens in the block, in the global order."""
    found = []
    for size in sorted({r[4] for r in rows}):
        own = [r for r in rows if r[4] == size]
        wanted = sorted({w for r in own for w in r[1][: r[2] - r[3] + 1]})
        vocabulary = set().union(*(r[1] for r in own))
        ranked = _strings([w for w in order if w in vocabulary])
        present = F.array_intersect(_strings(wanted), held)

        def of_class(present: Column, size=size, ranked=ranked) -> Column:
            at = F.filter(F.transform(held, lambda w, i: F.when(F.array_contains(present, w), F.floor(i / size).cast("int"))), lambda k: k.isNotNull())
            numbers = F.array_distinct(F.flatten(F.transform(F.array_distinct(at), lambda k: F.when(k > 0, F.array(k - 1, k)).otherwise(F.array(k)))))
            return F.transform(numbers, lambda k: F.struct(F.lit(size).alias("size_class"), k.alias("block"), F.array_intersect(ranked, F.slice(held, k * size + 1, 2 * size)).alias("held")))

        # the present tokens are made once, as the one element of a list
        none = F.array().cast("array<struct<size_class:int,block:int,held:array<string>>>")
        if_any = lambda of: lambda p: F.when(F.size(p) > 0, of(p)).otherwise(none)
        found.append(F.flatten(F.transform(F.array(present), if_any(of_class))))
    return F.concat(*found)


def containment_join(blocked: DataFrame, rows: list[tuple]) -> DataFrame:
    """blocked(keys..., size_class, block, held) -> (keys..., size_class, block, label, shared, size, containment) of every
    pair with enough tokens in common. rows: ranked templates, which are the caller's list and so small."""
    spark = blocked.sparkSession
    right = spark.createDataFrame(rows, "label string, tokens array<string>, size int, need int, t_class int")
    prefixes = right.select("label", "tokens", "size", "need", "t_class", F.posexplode(F.slice("tokens", 1, F.col("size") - F.col("need") + 1)).alias("i", "token"))
    # held is in the global order, for array_intersect keeps the order of its first argument
    seeds = blocked.select("*", F.posexplode("held").alias("j", "token"))
    pairs = seeds.join(F.broadcast(prefixes), ["token"]).where(
        (F.col("size_class") == F.col("t_class"))
        & (F.size("held") >= F.col("need"))
        & (F.least(F.col("size") - F.col("i"), F.size("held") - F.col("j")) >= F.col("need"))
    )
    # a pair is judged at the first token that it shares only
    shared = F.array_intersect("tokens", "held")
    keys = [c for c in blocked.columns if c != "held"]
    return (
        pairs.where(F.element_at(shared, 1) == F.col("token"))
        .select(*keys, "label", F.size(shared).alias("shared"), "size", (F.size(shared) / F.col("size")).alias("containment"), "need")
        .where("shared >= need")
        .drop("need")
    )


def phrase_places(held: Column, phrase: str) -> Column:
    """Word positions at which the words of a phrase stand one after another."""
    parts = phrase.split(" ")

    def here(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & (F.get(held, i + k) == part)
        return F.coalesce(test, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(held) - 1), here)


def scan(docs: DataFrame, templates: dict[str, str] | None = None, base_phrases: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Per row: n_words, n_base, first_word, last_word, base_labels, labels, score (best containment; 1 for a base phrase)."""
    templates = TEMPLATES if templates is None else templates
    base = BASE_PHRASES if base_phrases is None else base_phrases
    vocabulary = sorted({w for tokens in template_tokens(templates).values() for w in tokens})
    order = token_order(docs, vocabulary) if vocabulary else []
    ranked = ranked_templates(templates, order, threshold)
    any_base = "|".join(GAP.join(re.escape(w) for w in phrase.split(" ")) for phrase in base) or "(?!)"
    text = docs.select(
        "doc_id", words(F.col("text")).alias("held"), ascii_lower(F.coalesce("text", F.lit(""))).rlike(any_base).alias("maybe")
    )
    none = F.array().cast("array<int>")
    places = text.select(
        "doc_id",
        F.size("held").cast("long").alias("n_words"),
        *[
            F.when(F.col("maybe") & (F.size("held") >= len(p.split(" "))), phrase_places(F.col("held"), p)).otherwise(none).alias(f"at{k}")
            for k, p in enumerate(base)
        ],
        (blocks(F.col("held"), order, ranked) if ranked else F.array().cast("array<struct<size_class:int,block:int,held:array<string>>>")).alias("blocks"),
    )
    at = [F.col(f"at{k}") for k in range(len(base))]
    labels = F.array_sort(
        F.array_distinct(F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, base.values(), strict=True)]), lambda x: x.isNotNull()))
    )
    starts = F.flatten(F.array(*at)) if at else none
    places = places.select(
        "doc_id",
        F.monotonically_increasing_id().alias("row_no"),
        "n_words",
        F.size(starts).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        (labels if at else F.array().cast("array<string>")).alias("base"),
        "blocks",
    )
    places = materialize(places, "license-places")  # numbers of rows are fixed once written
    blocked = places.select("row_no", F.explode("blocks").alias("b")).select("row_no", "b.*")
    found = containment_join(blocked, ranked).groupBy("row_no").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    out = places.drop("blocks").join(found, "row_no", "left")
    every = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB: every block against every template of its class, by plain set intersection."""
    split = f"regexp_split_to_array({{}}, '{GAP}')"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    values = ", ".join(f"('{label}', {length_class(TEMPLATES[label])}, [{', '.join(repr(w) for w in tokens)}])" for label, tokens in template_tokens(TEMPLATES).items())
    starts = " UNION ALL ".join(
        f"SELECT doc_id, {phrase_at} AS spot, '{label}' AS label FROM w"
        for phrase, label in BASE_PHRASES.items()
        for phrase_at in [
            "unnest(list_filter(range(len(w)), lambda i: " + " AND ".join(f"coalesce(w[i + {k + 1}] = '{p}', false)" for k, p in enumerate(phrase.split())) + "))"
        ]
    )
    return f"""
    WITH w AS (SELECT doc_id, list_filter({split.format(low)}, lambda x: x <> '') AS w FROM documents),
    t(label, c, tokens) AS (VALUES {values}),
    k AS (SELECT doc_id, c, unnest(list_transform(range(0, len(w), c), lambda a: list_distinct(w[a + 1 : a + 2 * c]))) AS held FROM w, (SELECT DISTINCT c FROM t)),
    hit AS (SELECT doc_id, label, len(list_intersect(tokens, held)) / len(tokens) AS c FROM k JOIN t USING (c)
            WHERE len(list_intersect(tokens, held)) >= ceil(0.8 * len(tokens))),
    m AS (SELECT doc_id, list(DISTINCT label) AS more, max(c) AS best FROM hit GROUP BY doc_id),
    s AS ({starts}),
    b AS (SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list_sort(list(DISTINCT label)) AS base FROM s GROUP BY doc_id)
    SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
        coalesce(array_to_string(base, ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
        CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
    FROM w LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)"""
