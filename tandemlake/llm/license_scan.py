"""License scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

A file's units are compared with the templates as TF-IDF vectors, with document frequencies counted over all files for the
templates' words; other words weigh as unseen. Units are

- headers: each line, each paragraph without its comment marks, and each run of up to SENTENCES sentences of a paragraph,
  so that licences declared over several wrapped lines, or inside a longer paragraph, are seen as a whole;
- each run of up to LINES neighbouring lines that aren't blank, wherever in the text, which are compared with the titles
  of long licences;
- the whole text.

A file's own licence is its best unit's. A file whose whole text matches a template is a licence file, and so is one that
holds a long licence's title and a passage of its terms beside it: a title alone may be a mention. A file without a licence
of its own takes that of the nearest directory above it that has a licence file. Directories, not files, are resolved
against the directories above them.

Only units that hold an anchor are compared: a template's anchors are its rarest words, as many as it takes that what is
left of the template cannot reach the threshold, so that no unit is missed.

Defined results: null and empty texts have no licence of their own and may inherit one; a null path has neither directory
nor licence. Rows with equal paths share the best licence found in any of them, each row's units being compared by
themselves; one row out for each row in. Ties go to the greater licence name. Very long texts are split in one task, their
units are counted in as many as there are words. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate, pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

THRESHOLD = 0.8
SENTENCES, LINES = 3, 3
#: The cosine that templates of a name alone have to reach: their words, and no others.
EXACT = 0.999
#: Up to so many directories (some 100 bytes each) are broadcast to their files; more are joined by shuffle.
BROADCAST_DIRECTORIES = 100_000
#: Sentences and texts by which licences are declared.
_MIT_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = 'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THREE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_REST = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL_TERMS = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-2-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_REST}"),
    ("BSD-3-Clause", f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THREE} {_BSD_REST}"),
    ("BSD-3-Clause", _BSD_GRANT),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GPL_TERMS),
    ("ISC", _ISC),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_REST}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: What long licences begin with.
TITLES = (
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
)
#: Passages of long licences' terms.
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
TERMS = (
    ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-2.0", _VERBATIM),
    ("GPL-3.0", _VERBATIM),
    ("LGPL-3.0", _VERBATIM),
    ("MPL-2.0", '"Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.'),
)
#: Identifiers by which a line names a licence.
NAMED = tuple((name, f"SPDX-License-Identifier: {tag}") for name, tags in (("Apache-2.0", ("",)), ("BSD-2-Clause", ("",)), ("BSD-3-Clause", ("",)), ("CC-BY-4.0", ("",)), ("CC-BY-NC-4.0", ("",)), ("CC-BY-SA-4.0", ("",)), ("GPL-2.0", ("", "-only", "-or-later")), ("GPL-3.0", ("", "-only", "-or-later")), ("ISC", ("",)), ("LGPL-3.0", ("", "-only", "-or-later")), ("MIT", ("",)), ("MPL-2.0", ("",))) for tag in (name + t for t in tags))
#: Unit kinds.
HEADER, WHOLE, TITLE = 0, 1, 2


@dataclass(frozen=True)
class Texts:
    """What units are compared with, as (licence, text): headers and whole texts, titles, terms, names."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    titles: tuple[tuple[str, str], ...] = TITLES
    terms: tuple[tuple[str, str], ...] = TERMS
    named: tuple[tuple[str, str], ...] = NAMED

    def all(self) -> tuple[tuple[str, str], ...]:
        return (*self.templates, *self.titles, *self.terms, *self.named)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def frequencies(files: DataFrame, templates) -> tuple[int, dict[str, int]]:
    """(number of files, files that hold each of the templates' words); as many rows as the templates have words."""
    vocabulary = sorted({w for _, text in templates for w in _words(text)})
    held = files.select(F.explode(F.array_intersect(words(F.col("text")), F.lit(vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}
    return files.count(), {w: counts.get(w, 0) for w in vocabulary}


def vectors(n: int, df: dict[str, int], templates) -> list[tuple[str, dict[str, float], float]]:
    """(licence, weights, norm) of each template."""
    out = []
    for name, text in templates:
        weights = {w: tf * (math.log((n + 1) / (df[w] + 1)) + 1) for w, tf in sorted(Counter(_words(text)).items())}
        out.append((name, weights, math.sqrt(sum(x * x for x in weights.values()))))
    return out


def anchors(template: tuple[str, dict[str, float], float], threshold: float, df: dict[str, int] | None = None) -> set[str]:
    """Words without which the threshold is out of reach: those in the fewest files first, of these the heaviest."""
    _, weights, norm = template
    rest, out = norm * norm, set()
    for word in sorted(weights, key=lambda w: ((df or {}).get(w, 0), -weights[w], w)):
        if rest < (threshold * norm) ** 2 * 0.999:
            break
        rest -= weights[word] ** 2
        out.add(word)
    return out


def _bound(value: Column, use) -> Column:
    """use(value), with the value made once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text, without comment marks at the lines' begins and ends, each on one line."""
    marks = r"(?m)^[\s/*#;%!<>\-]+|[\s/*#>\-]+$"
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: F.regexp_replace(line, marks, ""))
    parts = F.split(F.array_join(lines, "\n"), "\n{2,}")
    return F.filter(F.transform(parts, lambda p: F.trim(F.replace(p, F.lit("\n"), F.lit(" ")))), lambda p: p != "")


def _runs(parts: Column, most: int) -> Column:
    """Each run of up to `most` neighbours, joined."""

    def of(n: int) -> Column:
        starts = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.lit(n)), " "))

    return F.concat(*[of(n) for n in range(1, most + 1)])


def units_of(text: Column) -> Column:
    """The units of a text: an array of structs kind, unit."""
    as_kind = lambda kind, texts: F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("unit")))

    def headers(whole: Column) -> Column:
        sentences = F.transform(whole, lambda p: _bound(F.split(p, r"(?<=[.;:!?])\s+"), lambda parts: _runs(parts, SENTENCES)))
        return F.concat(whole, F.flatten(sentences))

    def units(lines: Column) -> Column:
        full = F.filter(lines, lambda line: F.trim(line) != "")
        every = F.array_distinct(F.concat(lines, _bound(paragraphs(text), headers)))
        return F.concat(as_kind(HEADER, every), as_kind(WHOLE, F.array(text)), as_kind(TITLE, _bound(full, lambda held: _runs(held, LINES))))

    return _bound(F.split(text, r"\r?\n"), units)


def scores(units: DataFrame, n: int, df: dict[str, int], threshold: float, texts: Texts) -> DataFrame:
    """path, kind, best, terms: struct of score and licence of each unit (path, kind, unit) that reaches the threshold, null
    for units that only hold terms, and the licences whose terms it holds.

    Units of a path are told apart by their hash: what is equal is compared once.
    """
    order = vectors(n, df, texts.all())
    least = [threshold] * len(texts.templates + texts.titles + texts.terms) + [EXACT] * len(texts.named)
    held = set().union(*(anchors(t, x, df) for t, x in zip(order, least, strict=True)))
    near = units.where(F.arrays_overlap(words(F.col("unit")), F.lit(sorted(held)))).withColumn("same", F.xxhash64("unit")).dropDuplicates(["path", "kind", "same"])
    key = ["path", "kind", "same"]
    counted = near.select(*key, F.explode(words(F.col("unit"))).alias("word")).groupBy(*key, "word").agg(F.count("*").cast("double").alias("tf"))
    unseen = math.log(n + 1) + 1
    # for each of the templates' words its rarity and its weight in every template: a table of their size
    weights = [(w, [math.log((n + 1) / (df[w] + 1)) + 1, *(float(t[1].get(w, 0.0)) for t in order)]) for w in df]
    table = units.sparkSession.createDataFrame(weights, "word string, held array<double>")
    counted = counted.join(F.broadcast(table), "word", "left")
    weight = F.col("tf") * F.coalesce(F.get("held", F.lit(0)), F.lit(unseen))
    dots = [F.sum(F.coalesce(weight * F.get("held", F.lit(i + 1)), F.lit(0.0))).alias(f"dot{i}") for i in range(len(order))]
    unit = counted.groupBy(*key).agg(F.sqrt(F.sum(weight * weight)).alias("norm"), *dots)

    def reached(begin: int, size: int) -> Column:
        """Scores and licences of those of the texts that the unit is near enough to."""
        cosine = lambda i: F.struct((F.col(f"dot{i}") / (F.col("norm") * F.lit(order[i][2]))).alias("score"), F.lit(order[i][0]).alias("license"))
        return F.array_compact(F.array(*[F.when(cosine(i)["score"] >= least[i], cosine(i)) for i in range(begin, begin + size)]))

    ends = [0, *accumulate(map(len, (texts.templates, texts.titles, texts.terms, texts.named)))]
    of_text, of_title, of_terms, of_name = (reached(x, y - x) for x, y in pairwise(ends))
    best = F.array_max(F.when(F.col("kind") == TITLE, of_title).otherwise(F.concat(of_text, of_name)))
    terms = F.when(F.col("kind") == HEADER, F.transform(of_terms, lambda t: t["license"])).otherwise(F.array().cast("array<string>"))
    return unit.select("path", "kind", best.alias("best"), terms.alias("terms")).where(F.col("best").isNotNull() | (F.size("terms") > 0))


def parent(path: Column) -> Column:
    """The directory of a path; the root is the empty string."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """A directory and those above it, as an array from the root down."""
    parts = F.split(directory, "/")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))


def scanned(files: DataFrame, threshold: float = THRESHOLD, texts: Texts = Texts()) -> DataFrame:
    """path, license, score, origin (header or inherited), license_dir for each row of files (path, text)."""
    files = files.select("path", "text")
    n, df = frequencies(files, texts.all())
    held = set().union(*(anchors(t, threshold, df) for t in vectors(n, df, texts.all())))
    near = files.where("path is not null").where(F.arrays_overlap(words(F.col("text")), F.lit(sorted(held))))
    units = near.select("path", F.explode(units_of(F.col("text"))).alias("u")).select("path", "u.kind", "u.unit")
    # read twice, of the size of the licences found
    found = checkpointed(scores(units, n, df, threshold, texts))
    own = found.where("best is not null").groupBy("path").agg(F.max("best").alias("own"))
    terms = found.select("path", F.explode("terms").alias("of")).distinct()
    titled = found.where((F.col("kind") == TITLE) & F.col("best").isNotNull()).join(terms.withColumnRenamed("path", "at"), (F.col("path") == F.col("at")) & (F.col("best.license") == F.col("of")), "left_semi")
    licences = found.where((F.col("kind") == WHOLE) & F.col("best").isNotNull()).select("path", "best").unionByName(titled.select("path", "best"))
    licences = licences.groupBy(parent(F.col("path")).alias("held")).agg(F.max("best").alias("of_dir"))
    directories = files.where("path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    above = directories.select("dir", F.posexplode(ancestors(F.col("dir"))).alias("depth", "held"))
    nearest = above.join(licences, "held").groupBy("dir").agg(F.max(F.struct("depth", "held", "of_dir")).alias("from")).select(F.col("dir").alias("of"), "from")
    nearest = checkpointed(nearest)
    if nearest.count() <= BROADCAST_DIRECTORIES:
        nearest = F.broadcast(nearest)
    out = files.select("path").join(own.withColumnRenamed("path", "at"), F.col("path") == F.col("at"), "left")
    out = out.join(nearest, parent(F.col("path")) == F.col("of"), "left")
    mine = F.col("own").isNotNull()
    return out.select(
        "path", F.when(mine, F.col("own.license")).otherwise(F.col("from.of_dir.license")).alias("license"),
        F.round(F.when(mine, F.col("own.score")).otherwise(F.col("from.of_dir.score")), 6).alias("score"),
        F.when(mine, F.lit("header")).when(F.col("from").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(~mine, F.col("from.held")).alias("license_dir"),
    )
