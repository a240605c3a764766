"""License scans: normalised passages compared with licence templates by Dice coefficient over word bigrams.

A passage is a line, a paragraph (between blank lines), the whole text, or, for a licence that none of these
reaches, the best window of as many words as one of its templates. Windows are compared from each word pair that is in the template,
and only where the text holds as many of the template's bigrams as the threshold takes. Text and templates are lower-cased,
and everything but ASCII letters and digits becomes a space. For sets of bigrams A and B the coefficient
2|A and B| / (|A| + |B|) reaches t only if |B| is between |A| t / (2 - t) and |A| (2 - t) / t; templates
outside these bounds are not compared. The templates are one literal, so a scan is a narrow expression over
each row: nothing is shuffled, whatever the sizes or copies of the texts.

Edge cases: null, empty and short texts have no match (null licence, coefficient 0); of equal coefficients
the licence first in alphabetical order is named; repeated rows are scanned alike; very long texts are
scanned as a whole; an empty table gives no rows.
"""
from __future__ import annotations

import re
from collections.abc import Callable

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barloom.llm.common import table
from barloom.llm.registry import query

THRESHOLD = 0.8

# Public licence texts and notices, (licence, class, text).
TEMPLATES = [
    ("AGPL-3.0", "copyleft", """This program is free software: you can redistribute it and/or modify it under the terms
of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the
License, or (at your option) any later version."""),
    ("All-rights-reserved", "proprietary", "All rights reserved."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under
the License."""),
    ("BSD-2-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution."""),
    ("BSD-2-Clause", "permissive", "BSD 2-Clause License"),
    ("BSD-3-Clause", "permissive", "BSD 3-Clause License"),
    ("BSD-3-Clause", "permissive", """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of
its contributors may be used to endorse or promote products derived from this software without specific prior written
permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR
PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", """This work is licensed under a Creative Commons Attribution-NonCommercial 4.0
International License."""),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "copyleft", """This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International
License."""),
    ("CC0-1.0", "public-domain", """To the extent possible under law, the author has waived all copyright and related or
neighboring rights to this work."""),
    ("EPL-2.0", "copyleft", "Eclipse Public License 2.0"),
    ("EPL-2.0", "copyleft", """This program and the accompanying materials are made available under the terms of the
Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("GPL-2.0", "copyleft", """This program is free software; you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at
your option) any later version."""),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", """This program is free software: you can redistribute it and/or modify it under the terms of the
GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at
your option) any later version."""),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("ISC", "permissive", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without
fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE
SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
SOFTWARE."""),
    ("LGPL-2.1", "copyleft", "GNU Lesser General Public License version 2.1"),
    ("LGPL-2.1", "copyleft", """This library is free software; you can redistribute it and/or modify it under the terms of the
GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or
(at your option) any later version."""),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS
IN THE SOFTWARE."""),
    ("MPL-2.0", "copyleft", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", "public-domain", "This is free and unencumbered software released into the public domain."),
]


def template_words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split(" ")


def _template_bigrams(text: str) -> list[int]:
    """The bigrams as Spark's xxhash64 has them: the second word hashed with the first one's hash as seed."""
    def one(a: str, b: str) -> int:
        h = xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42))
        return h - (1 << 64) if h >> 63 else h

    w = template_words(text)
    return list(dict.fromkeys(one(a, b) for a, b in zip(w, w[1:])))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _literal(templates: list[tuple[str, str, str]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind"),
                              F.array(*[F.lit(b).cast("long") for b in _template_bigrams(text)]).alias("bigrams"))
                     for name, kind, text in templates])


def _words(passage: Column) -> Column:
    return F.split(F.btrim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")


def _bigrams(words: Column) -> Column:
    """In order, with repeats; none of a single word."""
    return F.when(F.size(words) < 2, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))


def window_matches(text: Column, found: Column, templates: list[tuple[str, str, str]], threshold: float) -> Column:
    """Array of (dice, license, kind, passage): the best window of each template whose licence is not in `found`."""
    literal = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind"), F.lit(len(template_words(t)) - 1).alias("length"),
                                 F.array(*[F.lit(b).cast("long") for b in _template_bigrams(t)]).alias("bigrams"))
                        for name, kind, t in templates])
    known = F.array(*[F.lit(b).cast("long") for b in sorted({b for _, _, t in templates for b in _template_bigrams(t)})])
    share = threshold / (2 - threshold) - 1e-9  # of its bigrams a template shares with any window that reaches the threshold

    def best(words: Column, own: Column, t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: F.array_contains(t["bigrams"], F.get(own, i)))

        def score(i: Column) -> Column:
            return _let(F.array_distinct(F.slice(own, i + 1, t["length"])), lambda b: F.struct(
                (F.size(F.array_intersect(b, t["bigrams"])) * 2.0 / (F.size(b) + F.size(t["bigrams"]))).alias("dice"), (-i).alias("at")))

        return _let(F.array_max(F.transform(starts, score)), lambda m: F.struct(
            m["dice"].alias("dice"), t["license"].alias("license"), t["kind"].alias("kind"),
            F.array_join(F.slice(words, 1 - m["at"], t["length"] + 1), " ").alias("passage")))

    def of_bigrams(words: Column, own: Column) -> Column:
        near = _let(F.array_intersect(own, known), lambda held: F.filter(literal, lambda t: (
            F.size(F.array_intersect(held, t["bigrams"])) >= F.size(t["bigrams"]) * share)
            & ~F.exists(found, lambda m: m["license"] == t["license"])))
        return F.filter(F.transform(near, lambda t: best(words, own, t)), lambda m: m["dice"] >= threshold)

    return _let(_words(text), lambda words: _let(_bigrams(words), lambda own: of_bigrams(words, own)))


def passage_matches(passage: Column, templates: list[tuple[str, str, str]], threshold: float) -> Column:
    """Array of (dice, license, kind) of the templates that the passage reaches the threshold with."""
    sizes = [len(_template_bigrams(t)) for _, _, t in templates]
    slack = 1e-9  # so that rounding never excludes a template that reaches the threshold exactly
    low, high = threshold / (2 - threshold) - slack, (2 - threshold) / threshold + slack
    all_templates = _literal(templates)
    empty = F.array().cast("array<struct<dice:double,license:string,kind:string>>")

    def compare(own: Column) -> Column:
        near = F.filter(all_templates, lambda t: (F.size(t["bigrams"]) >= F.size(own) * low) & (F.size(t["bigrams"]) <= F.size(own) * high))
        scored = F.transform(near, lambda t: F.struct(
            (F.size(F.array_intersect(own, t["bigrams"])) * 2.0 / (F.size(own) + F.size(t["bigrams"]))).alias("dice"),
            t["license"].alias("license"), t["kind"].alias("kind")))
        return F.filter(scored, lambda m: m["dice"] >= threshold)

    def of_words(words: Column) -> Column:
        bigrams = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2),
                                               lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1))))
        return F.when(F.size(words) - 1 < min(sizes) * low, empty).otherwise(
            _let(bigrams, lambda b: F.when(F.size(b) > max(sizes) * high, empty).otherwise(compare(b))))

    return _let(F.split(F.btrim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " "), of_words)


MOST_TEMPLATES, MOST_CHARS = 500, 1 << 20  # of a table of templates; they become a literal of the plan


def templates_of(frame: DataFrame) -> list[tuple[str, str, str]]:
    """Templates from a table (license, kind, text), in alphabetical order. A table above the bounds is refused, since
    its templates are sent with every task; rows without a licence or with fewer than two words are left out."""
    rows = frame.select("license", "kind", "text").where("license is not null and text is not null")
    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    if size["n"] > MOST_TEMPLATES or size["chars"] > MOST_CHARS:
        raise ValueError(f"{size['n']} templates with {size['chars']} characters are more than {MOST_TEMPLATES} with {MOST_CHARS}")
    return sorted((r["license"], r["kind"] or "", r["text"]) for r in rows.collect() if len(template_words(r["text"])) > 1)


def scan(docs: DataFrame, text: str = "text", templates: list[tuple[str, str, str]] | DataFrame | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """The rows with `matches`, an array of (dice, license, kind, passage), best first; it replaces a column of that
    name. Templates are a list of (license, kind, text) or a table of them."""
    use = TEMPLATES if templates is None else templates_of(templates) if isinstance(templates, DataFrame) else templates
    if not use:
        raise ValueError("there are no templates")
    if not 0 < threshold <= 1 or any(len(template_words(t)) < 2 for _, _, t in use):
        raise ValueError("the threshold is in (0, 1] and a template has two words or more")
    whole = F.coalesce(F.col(text), F.lit(""))
    paragraphs = F.split(whole, r"\n[ \t\r]*\n")
    blocks = F.when(F.size(paragraphs) > 1, F.concat(F.array(whole), paragraphs)).otherwise(F.array(whole))
    passages = F.array_distinct(F.transform(F.concat(F.split(whole, "\n"), blocks), lambda p: F.btrim(p, F.lit(" \t\n\r"))))
    found = F.flatten(F.transform(passages, lambda p: F.transform(
        passage_matches(p, use, threshold), lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"),
                                                               m["kind"].alias("kind"), p.alias("passage")))))

    found = _let(found, lambda f: F.concat(f, window_matches(whole, f, use, threshold)))
    best = F.array_sort(found, lambda a, b: F.when(a["dice"] > b["dice"], -1).when(a["dice"] < b["dice"], 1)
                        .when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1)
                        .when(a["passage"] < b["passage"], -1).when(a["passage"] > b["passage"], 1).otherwise(0))
    rest = [c for c in docs.columns if c != "matches"]
    return docs.withColumn("matches", F.explode(F.array(best))).select(*rest, "matches")


def _oracle() -> str:
    rows = ", ".join("('{}', '{}', '{}')".format(n, k, " ".join(template_words(t))) for n, k, t in TEMPLATES)
    return f"""
WITH templates AS (
  SELECT license, kind, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT license, kind, string_split(words, ' ') AS w FROM (VALUES {rows}) AS t(license, kind, words))),
passages AS (
  SELECT DISTINCT doc_id, trim(p, ' ' || chr(9) || chr(10) || chr(13)) AS p FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p FROM documents
    UNION ALL SELECT doc_id, unnest(string_split_regex(coalesce(text, ''), '\\n[ \\t\\r]*\\n')) FROM documents
    UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)),
bigrams AS (
  SELECT doc_id, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
  FROM (SELECT doc_id, p, string_split(trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM passages)),
hits AS (
  SELECT * FROM (
    SELECT doc_id, p, license, kind, len(list_intersect(x.b, t.b)) * 2e0 / (len(x.b) + len(t.b)) AS dice
    FROM bigrams x CROSS JOIN templates t)
  WHERE dice >= {THRESHOLD}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, license, p) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM hits)
SELECT d.doc_id, b.license, b.kind, coalesce(b.dice, 0e0) AS dice, coalesce(b.n, 0) AS n_matches
FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id AND b.k = 1"""


@query("op10_licenses", _oracle())
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    first = F.get("matches", F.lit(0))
    return found.select("doc_id", first["license"].alias("license"), first["kind"].alias("kind"),
                        F.coalesce(first["dice"], F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches"))
