"""License scans: Dice coefficient of word bigrams against license templates.

A document is normalised (A-Z lowered, everything but letters and digits of ASCII a separator)
and looked at as a whole, by paragraphs and by lines. Each such unit's distinct word
bigrams meet those of the templates in an equi-join, and the coefficient is twice the number
shared over the sum of both numbers. Unless such a unit is the template itself, the template is
looked for in every run of consecutive words of a fitting length as well, so a text in several
paragraphs before code, a notice inside a sentence, or one that shares its line with other
words, counts for what it is wherever lines break. Three bounds come first: a document that
does not hold the share of a template's bigrams that the threshold takes is not looked at, a unit
whose number of bigrams cannot reach the threshold with any template is not taken apart, and a
bigram only meets templates of a size that fits its unit's.

Everything is DataFrame expressions. Templates are a parameter of a few texts; Spark sees their
size and broadcasts their bigrams by itself while they are small.

Defined cases: a null or empty text has no units; a unit of fewer than two words has no bigrams
and matches nothing; a unit that occurs twice in a document is one unit; of equally good
templates the first by name is named; repeated rows give equal results; an empty table gives no
rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping
from importlib import resources

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.sortkeys import quoted
from millrace.llm.common import prepare, stored
from millrace.session import local_frame

THRESHOLD = 0.8

#: License texts and notices without names and years, typed and not compared with
#: a published copy.
TEMPLATES = {
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted."
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR '
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version. This program is distributed in the hope that it will be useful, "
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a "
        "copy of the GNU General Public License along with this program. If not, see "
        "<https://www.gnu.org/licenses/>."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
        "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction, including '
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
        "the following conditions: The above copyright notice and this permission notice shall be included in "
        'all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY '
        "OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
        "SOFTWARE."
    ),
}

_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as "
    "published by the Free Software Foundation, either version {1} of the License, or (at your option) any later "
    "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
    "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more "
    "details. You should have received a copy of the GNU {0} along with this program. If not, see "
    "<https://www.gnu.org/licenses/>."
)

#: Standard notices of the licenses in ``license_texts``.
NOTICES = {
    "AGPL-3.0 header": _GNU.format("Affero General Public License", "3"),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work."
    ),
    "GPL-2.0 header": _GNU.format("General Public License", "2"),
    "LGPL-2.1 header": _GNU.format("Lesser General Public License", "2.1"),
    "LGPL-3.0 header": _GNU.format("Lesser General Public License", "3"),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}


def full_texts() -> dict[str, str]:
    """The texts kept beside this module, by names such as ``BSD-3-Clause text``."""
    found = [p for p in (resources.files(__package__) / "license_texts").iterdir() if p.name.endswith(".txt")]
    if not found:
        raise FileNotFoundError("The package has no license texts.")
    texts = {p.name.removesuffix(".txt"): p.read_text(encoding="utf-8") for p in found}
    return {f"{name} text": texts[name] for name in sorted(texts)}


#: What a scan looks for: notices and full texts, 33 of some 35,000 words. The first sentence of
#: 0BSD alone is also that of ISC, so 0BSD is there by its full text only.
LICENSES = {k: v for k, v in TEMPLATES.items() if k != "0BSD"} | NOTICES | full_texts()

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(text, _UPPER, _UPPER.lower()), "[^a-z0-9]+", " "))


_BREAK = "\x01"


def units_of(text: Column) -> Column:
    """The whole text, its paragraphs and its lines, normalised, each once.

    Paragraphs are parted by lines of white space. The text is normalised in one go, line ends
    and marks between paragraphs being kept.
    """
    marked = F.translate(text, _BREAK + _UPPER, "-" + _UPPER.lower())
    marked = F.regexp_replace(marked, "\n[ \t\r\n]*\n", f"\n{_BREAK}\n")
    kept = F.regexp_replace(marked, f"[^a-z0-9\n{_BREAK}]+", " ")
    lines = F.filter(
        F.transform(F.split(kept, "\n"), lambda line: F.trim(line)), lambda line: line != ""
    )
    joined = F.array_join(lines, " ")
    paragraphs = F.transform(F.split(joined, _BREAK), lambda part: F.trim(part))
    whole = F.array(F.array_join(F.filter(paragraphs, lambda part: part != ""), " "))
    units = F.array_distinct(F.concat(whole, paragraphs, lines))
    return F.filter(units, lambda unit: (unit != "") & (unit != _BREAK))


def bigrams_of(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(
        F.zip_with(
            F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
    )


def template_bigrams(spark, templates: Mapping[str, str]) -> DataFrame:
    """``(license, size, bigram)`` of every template."""
    frame = local_frame(
        spark, {"license": list(templates) or [""], "text": list(templates.values()) or [""]}
    )
    bigrams = frame.select("license", bigrams_of(F.split(normalised(F.col("text")), " ")).alias("bigrams"))
    return bigrams.select("license", F.size("bigrams").alias("size"), F.explode("bigrams").alias("bigram"))


def template_keys(known: DataFrame, threshold: float) -> DataFrame:
    """``(key, license, need)``: hashed bigrams, and how many of them a document has to hold.

    A coefficient of the threshold takes a share of a template's bigrams, however short the
    unit is. Of a long text only the longest bigrams stand here, which prose seldom has; as many
    of them may be missing as of all.
    """
    need = F.ceil(F.col("size") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    spare = F.col("size") - F.col("need")
    used = F.when(F.col("size") < 64, F.col("size")).otherwise(spare + F.ceil(F.col("need") / 4).cast("int"))
    order = Window.partitionBy("license").orderBy(F.length("bigram").desc(), "bigram")
    return (
        known.withColumn("need", need)
        .withColumn("used", used)
        .withColumn("place", F.row_number().over(order))
        .filter("place <= used")
        .select(F.xxhash64("bigram").alias("key"), "license", (F.col("used") - spare).alias("need"))
    )


def runs_of(docs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """``(row, license, dice)``: the best run of words of each document for each template.

    ``docs`` are ``(row, text)``. A run is a stretch of consecutive words, over lines and
    paragraphs, of no more pairs of neighbours than the template's size lets reach the
    threshold. The best one begins and ends with a pair that the template has, and with fewer
    such pairs in reach than the threshold takes, a start is not followed.
    """
    words = F.split(normalised(F.col("text")), " ")
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    placed = docs.dropDuplicates(["row"]).select("row", F.posexplode(pairs).alias("pos", "bigram"))
    known = known.withColumn("longest", F.floor(F.col("size") * ((2 - threshold) / threshold) + 1e-9).cast("int"))
    need = F.ceil(F.col("size") * (threshold / (2 - threshold)) - 1e-9).cast("int")
    hits = (
        placed.join(known, "bigram")
        .groupBy("row", "license", "size", "longest")
        .agg(F.sort_array(F.collect_list("pos")).alias("at"))
        .withColumn("need", need)
    )
    hits = stored(hits, "places")
    # Going back over a pair that the template has never lowers the coefficient, so runs begin
    # where such pairs do, and are longer by as many as follow one another there.
    marked = F.transform("at", lambda p, k: F.struct(p.alias("p"), k.alias("k"), F.get("at", k - 1).alias("last")))
    first = F.filter(marked, lambda x: F.coalesce(x["last"] != x["p"] - 1, F.lit(True)))
    follow = F.concat(F.slice(first, 2, F.size("at")), F.array(F.struct(F.lit(0).alias("p"), F.size("at").alias("k"), F.lit(0).alias("last"))))
    streaks = F.zip_with(
        first,
        follow,
        lambda x, y: F.struct(x["p"].alias("p"), x["k"].alias("k"), (F.col("longest") + y["k"] - x["k"]).alias("reach")),
    )
    starts = F.filter(
        streaks, lambda x: F.coalesce(F.get("at", x["k"] + F.col("need") - 1) - x["p"] < x["reach"], F.lit(False))
    )
    hits = stored(hits.withColumn("starts", starts).filter(F.size("starts") > 0), "starts")
    # Where each pair stood before, so that a run counts it once.
    before = Window.partitionBy("row", "bigram").orderBy("pos")
    texts = (
        placed.join(hits.select("row").distinct(), "row", "left_semi")
        .withColumn("before", F.coalesce(F.lag("pos").over(before), F.lit(-1)))
        .groupBy(F.struct("row").alias("k"))
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "before"))), lambda x: x["before"]).alias("before"))
        .select("k.row", "before")
    )
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("both"), F.lit(0.0).alias("dice"))

    def best_from(run: Column) -> Column:
        start = run["p"]

        def step(state: Column, item: Column) -> Column:
            first = (item["before"] < start).cast("int")
            n = state["n"] + first
            both = state["both"] + F.when(item["hit"], first).otherwise(0)
            dice = F.when(item["hit"], F.greatest(state["dice"], 2.0 * both / (n + F.col("size"))))
            return F.struct(n.alias("n"), both.alias("both"), F.coalesce(dice, state["dice"]).alias("dice"))

        return F.aggregate(F.slice("items", start + 1, run["reach"]), none, step, lambda state: state["dice"])

    # Whether the template has the pair, by place: as many noes as lie between two hits, and a yes.
    gaps = F.zip_with(
        "at",
        F.slice(F.concat(F.array(F.lit(-1)), "at"), 1, F.size("at")),
        lambda p, last: F.concat(F.array_repeat(F.lit(False), p - last - 1), F.array(F.lit(True))),
    )
    items = F.zip_with(
        "before", F.flatten(gaps), lambda b, hit: F.struct(b.alias("before"), F.coalesce(hit, F.lit(False)).alias("hit"))
    )
    dice = F.array_max(F.transform("starts", best_from))
    # Stored, as an expression for them would be evaluated again for each start.
    runs = stored(hits.join(texts, "row").withColumn("items", items).drop("before", "at"), "runs")
    return runs.select("row", "license", dice.alias("dice")).filter(F.col("dice") >= threshold)


def scan_licenses(
    docs: DataFrame,
    templates: Mapping[str, str] = LICENSES,
    threshold: float = THRESHOLD,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(id, license, dice, n_matches)``: the best template of each document, or null.

    ``dice`` is the best of all units and runs of words. ``n_matches`` counts the pairs of a unit
    and a template that reach the threshold; a template that only a run of words reaches counts
    once.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select(
        F.col(quoted(id_column)).alias("id"),
        F.coalesce(F.col(quoted(text_column)).cast("string"), F.lit("")).alias("text"),
    ).withColumn("row", F.xxhash64("id", "text"))
    known = stored(template_bigrams(spark, templates), "templates")
    sizes = [r["size"] for r in known.select("size").distinct().collect()]
    # Only texts with enough of a template's bigrams, wherever they stand, can hold it.
    words = F.split(normalised(F.col("text")), " ")
    keys = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)),
    )
    able = (
        rows.select("row", F.explode(F.array_distinct(keys)).alias("key"))
        .join(stored(template_keys(known, threshold), "keys"), "key")
        .groupBy("row", "license", "need")
        .agg(F.count(F.lit(1)).alias("held"))
        .filter(F.col("held") >= F.col("need"))
        .select("row", "license")
    )
    able = stored(able, "able")
    some_of = able.groupBy(F.struct("row").alias("k")).agg(F.count(F.lit(1))).select("k.row")
    likely = stored(rows.select("row", "text").join(some_of, "row", "left_semi"), "likely")
    # Of two sizes, the coefficient is at most twice the smaller over their sum.
    lowest = min(sizes, default=1) * threshold / (2 - threshold)
    highest = max(sizes, default=0) * (2 - threshold) / threshold
    units = likely.select("row", F.explode(units_of(F.col("text"))).alias("unit")).withColumn(
        "words", F.length("unit") - F.length(F.translate("unit", " ", "")) + 1
    )
    # Sizes come before anything is taken apart whole: a unit of too few words has too few
    # bigrams, and one whose first words have too many has too many.
    some = int(highest) + 64
    head = bigrams_of(F.split(F.substring_index("unit", " ", some), " "))
    fitting = units.filter(F.col("words") > lowest).withColumn("head", head).filter(F.size("head") <= highest)
    apart = (
        fitting.withColumn(
            "bigrams",
            F.when(F.col("words") <= some, F.col("head")).otherwise(bigrams_of(F.split("unit", " "))),
        )
        .withColumn("n", F.size("bigrams"))
        .filter((F.col("n") >= lowest) & (F.col("n") <= highest))
        .select("row", F.xxhash64("unit").alias("unit"), "n", F.explode("bigrams").alias("bigram"))
    )
    shared = apart.join(known, "bigram").filter(
        2 * F.least("n", "size") >= threshold * (F.col("n") + F.col("size"))
    )
    counted = shared.groupBy("row", "unit", "license", "n", "size").agg(F.count_distinct("bigram").alias("both"))
    dice = 2.0 * F.col("both") / (F.col("n") + F.col("size"))
    hits = counted.withColumn("dice", dice).filter(F.col("dice") >= threshold).select("row", "license", "dice")
    hits = stored(hits, "hits")
    # A template may stand better in a run of words, unless a unit is the template itself.
    of_units = hits.groupBy("row", "license").agg(F.max("dice").alias("dice"), F.count(F.lit(1)).alias("units"))
    of_units = stored(of_units, "units")
    open_pairs = stored(able.join(of_units.filter("dice = 1"), ["row", "license"], "left_anti"), "open")
    within = likely.join(open_pairs.select("row").distinct(), "row", "left_semi")
    runs = runs_of(within, known, threshold).join(open_pairs, ["row", "license"], "left_semi")
    both = of_units.unionByName(runs.withColumn("units", F.lit(0).cast("bigint")))
    both = both.groupBy("row", "license").agg(F.max("dice").alias("dice"), F.greatest(F.sum("units"), F.lit(1)).alias("n"))
    best = both.groupBy(F.struct("row").alias("k")).agg(
        F.min_by("license", F.struct((-F.col("dice")).alias("d"), "license")).alias("license"),
        F.max("dice").alias("dice"),
        F.sum("n").alias("n_matches"),
    )
    return rows.select("id", "row").join(best.select("k.row", "license", "dice", "n_matches"), "row", "left").select(
        "id", "license", "dice", F.coalesce("n_matches", F.lit(0)).cast("bigint").alias("n_matches")
    )
