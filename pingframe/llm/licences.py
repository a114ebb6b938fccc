"""Licence scans: Dice coefficient of word bigrams between normalised text and licence templates, in DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices, grants and whole short licences by SPDX-like name. A name can have several templates.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License.",
    ),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License.",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See the LICENSE file for details."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS "
        "PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    *(
        (name, text)
        for name, kind, version, thing in (
            ("GPL-3.0", "GNU General Public License", "version 3", "program"),
            ("GPL-2.0", "GNU General Public License", "version 2", "program"),
            ("LGPL-3.0", "GNU Lesser General Public License", "version 3", "library"),
            ("LGPL-2.1", "GNU Lesser General Public License", "version 2.1", "library"),
            ("AGPL-3.0", "GNU Affero General Public License", "version 3", "program"),
        )
        for text in (
            f"This work is licensed under the {kind}, {version}.",
            f"This {thing} is licensed under the {kind}, {version}.",
            f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the "
            f"Free Software Foundation, either {version} of the License, or (at your option) any later version.",
            f"This {thing} is free software: you can redistribute it and/or modify it under the terms of the {kind} as published by the "
            f"Free Software Foundation, either {version} of the License, or (at your option) any later version. This {thing} is "
            "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {kind} for more details. You should have received a copy of the "
            f"{kind} along with this {thing}. If not, see https://www.gnu.org/licenses/.",
        )
    ),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    *(
        (
            name,
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
            "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
            "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
            f"distribution.{third} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
            "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR "
            "PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
            "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
            "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
            "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF "
            "THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
        )
        for name, third in (
            ("BSD-2-Clause", ""),
            (
                "BSD-3-Clause",
                " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                "derived from this software without specific prior written permission.",
            ),
        )
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS "
        "IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    *(
        (f"CC-{kind}-{version}", text)
        for kind, said in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
        for version, port in (("4.0", "International"), ("3.0", "Unported"))
        for text in (f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {said} {version} {port} License.")
    ),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
        "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.",
    ),
)
LEAST = 0.8
COMMON = frozenset("a all and any at be by for from in is it not of on or that the this to use with you".split())


def normal(text: Column) -> Column:
    """Lower case; every run of characters that are no letters or digits is one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _bigrams(words: Column) -> Column:
    """The pairs of words in a row, joined by a space, in order."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def _template(text: str) -> list[str]:
    words = _words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _anchors(bigrams: list[str], low: float) -> set[str]:
    """Words of which a text must hold one to hold the share `low` of the bigrams: the longest ones, those in every prose last, until too
    few bigrams are without."""
    out: set[str] = set()
    for word in sorted({w for b in bigrams for w in b.split(" ")}, key=lambda w: (w in COMMON, -len(w), w)):
        if sum(out.isdisjoint(b.split(" ")) for b in bigrams) < low * len(bigrams) - 1e-9:
            break
        out.add(word)
    return out


def rivals(templates: tuple[tuple[str, str], ...], least: float) -> list[list[tuple[list[str], list[str]]]]:
    """For each template the bigrams that it alone has and those that the other alone has, against every template of another name that one passage could
    be like both."""
    sets = [set(_template(t)) for _, t in templates]
    near = 2 * least - 1
    return [
        [(sorted(own - other), sorted(other - own)) for k, other in enumerate(sets) if templates[k][0] != templates[n][0] and 2 * len(own & other) >= near * (len(own) + len(other))]
        for n, own in enumerate(sets)
    ]


def scanned(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, n_units, n_licensed, n_passages, licences, best_licence, best_score) of each row of docs.

    Units are the lines of a text and, if it has several, the text as a whole; n_licensed of the n_units have a licence. Passages are
    windows of a text's words, whatever its line breaks: as many words as a template has, from a bigram of it on. A unit or passage of
    bigram set A is like a template of set B where 2 |A and B| / (|A| + |B|) >= least, and has its licence if, against each rival, a template
    of another name that is much like it, A holds more of the bigrams that B alone has than of those that the rival alone has: so another version or
    kind of the same words is not taken for it, nor is one that no template has. Each unit has the licence of its best template. Of passages of
    one template that overlap, the best one stays; of those of several templates, taken from the best score on (then from the most bigrams in common),
    those that overlap none before. n_passages counts them.

    Only sizes with least / (2 - least) <= |A| / |B| <= (2 - least) / least can reach that, so other templates are not compared; a unit
    with too few words, or too many distinct ones, has no bigrams made; a text without any word that all matches must have is not cut
    up; and a template of which a text holds too small a share has no passages looked at. licences: names, sorted, comma-joined; best: highest score, ties to the earlier template; without one null and
    0. Null texts have no units. One pass, no shuffle.
    """
    sets = [_template(t) for _, t in templates]
    low, high = least / (2 - least), (2 - least) / least
    fewest, most = low * min(map(len, sets)), high * max(map(len, sets))
    known = sorted(set().union(*sets))
    every = [
        {"n": n, "name": name, "wide": len(_words(text)) - 1, "b": s, "rivals": [{"own": own, "other": other} for own, other in others]}
        for n, ((name, text), s, others) in enumerate(zip(templates, sets, rivals(templates, least), strict=True))
    ]
    them = F.from_json(F.lit(json.dumps(every)), "array<struct<n: int, name: string, wide: int, b: array<string>, rivals: array<struct<own: array<string>, other: array<string>>>>>")
    whole = F.col("text").cast("string")
    lines = F.split(whole, "\n", -1)
    units = F.when(F.col("text").isNull(), F.array().cast("array<string>")).when(F.size(lines) > 1, F.concat(F.array(whole), lines)).otherwise(lines)
    worded = docs.select("doc_id", units.alias("u"), F.split(normal(F.coalesce(whole, F.lit(""))), " ", -1).alias("w"))
    held = F.arrays_overlap("w", F.lit(sorted(set().union(*(_anchors(s, low) for s in sets)))))
    none = F.array().cast("array<string>")
    worded = worded.select("doc_id", F.size("u").cast("long").alias("n_units"), F.when(held, F.col("w")).otherwise(none).alias("w"), F.when(held, F.col("u")).otherwise(none).alias("u"))
    worded = worded.withColumn("uw", F.transform("u", lambda u: F.split(normal(u), " ", -1)))
    fit = worded.withColumn("uw", F.filter("uw", lambda w: (F.size(w) - 1 >= F.lit(fewest)) & (F.size(F.array_distinct(w)) - 1 <= F.lit(most))))
    grams = fit.select("doc_id", "n_units", F.transform("uw", lambda w: F.array_distinct(_bigrams(w))).alias("g"), _bigrams(F.col("w")).alias("b"))

    def shared(g: Column, own: Column) -> Column:
        return F.size(F.array_intersect(g, own))

    def rated(g: Column, t: Column) -> Column:
        return F.lit(2.0) * shared(g, t["b"]) / (F.size(g) + F.size(t["b"]))

    def decided(g: Column, t: Column) -> Column:
        """g holds more of what template t alone has than of what each rival alone has."""
        return F.forall(t["rivals"], lambda r: shared(g, r["own"]) > shared(g, r["other"]))

    def hit(g: Column) -> Column:
        """The best template of a unit."""
        inside = F.filter(them, lambda t: F.size(g).between(F.size(t["b"]) * F.lit(low) - F.lit(1e-9), F.size(t["b"]) * F.lit(high) + F.lit(1e-9)))
        like = F.filter(inside, lambda t: (rated(g, t) >= F.lit(least)) & decided(g, t))
        return F.array_max(F.transform(like, lambda t: F.struct(rated(g, t).alias("score"), (-t["n"]).alias("n"), t["name"].alias("name"))))

    at = F.filter(F.transform("b", lambda x, i: F.when(x.isin(known), F.struct(i.alias("i"), x.alias("x")))), lambda h: h.isNotNull())
    found = grams.select("doc_id", "n_units", "b", F.filter(F.transform("g", hit), lambda h: h.isNotNull()).alias("h"), at.alias("at"))
    found = found.withColumn("met", F.array_distinct(F.transform("at", lambda h: h["x"])))

    def passages(t: Column) -> Column:
        """The windows of a template that have its licence, as (n, start, end, score, hits, name)."""

        def window(h: Column) -> Column:
            a = F.array_distinct(F.slice("b", h["i"] + 1, t["wide"]))
            own = F.struct(t["n"].alias("n"), h["i"].alias("start"), (h["i"] + t["wide"] + 1).alias("end"), rated(a, t).alias("score"), shared(a, t["b"]).alias("hits"), t["name"].alias("name"))
            return F.when((rated(a, t) >= F.lit(least)) & decided(a, t), own)

        return F.filter(F.transform(F.filter("at", lambda h: F.array_contains(t["b"], h["x"])), window), lambda p: p.isNotNull())

    near = F.filter(them, lambda t: (F.size("met") >= F.size(t["b"]) * F.lit(low) - F.lit(1e-9)) & (shared(F.col("met"), t["b"]) >= F.size(t["b"]) * F.lit(low) - F.lit(1e-9)))
    windows = F.flatten(F.transform(near, passages))
    found = found.select("doc_id", "n_units", "h", F.array_sort(windows).alias("p"))

    def swept(chosen: Column, p: Column) -> Column:
        """p, in the order of templates and starts, after the ones chosen: a better one takes the place of the last that it overlaps."""
        last = F.element_at(chosen, -1)
        apart = (F.size(chosen) == 0) | (last["n"] != p["n"]) | (last["end"] <= p["start"])
        return F.when(apart, F.concat(chosen, F.array(p))).when(p["score"] > last["score"], F.concat(F.slice(chosen, 1, F.size(chosen) - 1), F.array(p))).otherwise(chosen)

    def spared(chosen: Column, p: Column) -> Column:
        over = F.exists(chosen, lambda q: (q["start"] < p["end"]) & (p["start"] < q["end"]))
        return F.when(over, chosen).otherwise(F.concat(chosen, F.array(p)))

    found = found.withColumn("p", F.aggregate("p", F.filter("p", lambda _: F.lit(False)), swept))
    ranked = F.array_sort(F.transform("p", lambda p: F.struct((-p["score"]).alias("minus"), (-p["hits"]).alias("fewer"), p["n"].alias("n"), p["start"].alias("start"), p["end"].alias("end"), p["score"].alias("score"), p["name"].alias("name"))))
    found = found.select("doc_id", "n_units", "h", ranked.alias("p"))
    found = found.withColumn("p", F.aggregate("p", F.filter("p", lambda _: F.lit(False)), spared))
    best = F.array_max(F.concat("h", F.transform("p", lambda p: F.struct(p["score"].alias("score"), (-p["n"]).alias("n"), p["name"].alias("name")))))
    names = F.concat(F.transform("h", lambda x: x["name"]), F.transform("p", lambda p: p["name"]))
    return found.select(
        "doc_id", "n_units", F.size("h").cast("long").alias("n_licensed"), F.size("p").cast("long").alias("n_passages"), F.array_join(F.array_sort(F.array_distinct(names)), ",").alias("licences"),
        best["name"].alias("best_licence"), F.round(F.coalesce(best["score"], F.lit(0.0)), 6).alias("best_score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: DuckDB SQL of scanned(), which compares every line with every template, and every window from a bigram of a template on; the rivals are found anew.
SQL = rf"""
WITH raw AS (SELECT * FROM (VALUES {", ".join(f"({n}, {_quoted(a)}, {_quoted(b)})" for n, (a, b) in enumerate(TEMPLATES))}) AS v(n, name, t)),
tw AS (SELECT n, name, string_split(trim(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM raw),
tb AS (SELECT n, name, len(w) - 1 AS wide, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM tw),
tr AS (SELECT t.n, list_filter(t.b, lambda x: NOT list_contains(r.b, x)) AS own, list_filter(r.b, lambda x: NOT list_contains(t.b, x)) AS other
  FROM tb t JOIN tb r ON t.name <> r.name AND 2 * len(list_intersect(t.b, r.b)) >= {2 * LEAST - 1} * (len(t.b) + len(r.b))),
u AS (SELECT doc_id, 0 AS k, text AS u FROM documents WHERE contains(text, chr(10))
  UNION ALL SELECT doc_id, i AS k, string_split(text, chr(10))[i] FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS x(i)),
uw AS (SELECT doc_id, k, string_split(trim(regexp_replace(lower(u), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM u),
ub AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM uw),
us AS (SELECT doc_id, k, n, name, ub.b AS a, 2.0 * len(list_intersect(ub.b, tb.b)) / (len(ub.b) + len(tb.b)) AS score FROM ub, tb),
uh AS (SELECT doc_id, k, arg_max(name, struct_pack(s := score, n := -n)) AS name, max(score) AS score, arg_max(n, struct_pack(s := score, n := -n)) AS n FROM us
  WHERE score >= {LEAST} AND NOT EXISTS (FROM tr WHERE tr.n = us.n AND len(list_intersect(a, own)) <= len(list_intersect(a, other))) GROUP BY doc_id, k),
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
db AS (SELECT doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS b FROM dw),
place AS (SELECT doc_id, i, b[i] AS x FROM db, unnest(range(1, len(b) + 1)) AS y(i)),
hit AS (SELECT doc_id, n, i FROM place JOIN (SELECT n, unnest(b) AS x FROM tb) AS tx USING (x)),
win AS (SELECT hit.doc_id, n, name, i, i + wide + 1 AS e, list_distinct(db.b[i:i + wide - 1]) AS a, tb.b AS b FROM hit JOIN db USING (doc_id) JOIN tb USING (n)),
p AS (SELECT doc_id, n, name, i, e, a, len(list_intersect(a, b)) AS hits, 2.0 * len(list_intersect(a, b)) / (len(a) + len(b)) AS score FROM win),
pl AS (SELECT doc_id, struct_pack(n := n, i := i, e := e, score := score, hits := hits, name := name) AS p FROM p
  WHERE score >= {LEAST} AND NOT EXISTS (FROM tr WHERE tr.n = p.n AND len(list_intersect(a, own)) <= len(list_intersect(a, other)))),
one AS (SELECT doc_id, list_reduce(list([p] ORDER BY p.n, p.i), lambda c, x: CASE WHEN c[-1].n <> x[1].n OR c[-1].e <= x[1].i THEN list_concat(c, x) WHEN x[1].score > c[-1].score THEN list_concat(c[:-2], x) ELSE c END) AS c FROM pl GROUP BY doc_id),
each AS (SELECT doc_id, unnest(c) AS p FROM one),
kept AS (SELECT doc_id, unnest(list_reduce(list([p] ORDER BY p.score DESC, p.hits DESC, p.n, p.i), lambda c, x: CASE WHEN len(list_filter(c, lambda q: q.i < x[1].e AND x[1].i < q.e)) > 0 THEN c ELSE list_concat(c, x) END)) AS p FROM each GROUP BY doc_id),
l AS (SELECT doc_id, k, n, name, score FROM uh UNION ALL SELECT doc_id, NULL, p.n, p.name, p.score FROM kept),
h AS (SELECT doc_id, count(k) AS n_licensed, count(*) - count(k) AS n_passages, string_agg(DISTINCT name, ',' ORDER BY name) AS licences, first(name ORDER BY score DESC, n) AS best_licence, max(score) AS best_score
  FROM l GROUP BY doc_id),
c AS (SELECT doc_id, count(*) AS n_units FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_licensed, 0) AS BIGINT) AS n_licensed, CAST(coalesce(n_passages, 0) AS BIGINT) AS n_passages,
  coalesce(licences, '') AS licences, best_licence, round(coalesce(best_score, 0.0), 6) AS best_score
FROM documents d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
"""
