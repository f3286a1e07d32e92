"""Licence scan: Dice coefficient of word bigrams against licence templates, in DataFrame functions only.

Units of a text are the text as a whole, its lines, its paragraphs of several lines (between blank lines), and the
passages that begin with the opening words of a longer template, however they are wrapped: from those words as far
as the template is long, or to the next time they occur. Words are runs of letters in lower case, so case, punctuation,
numbers and layout do not count. Dice is 2 * common / (a + b) over distinct bigrams. It can reach the threshold only if
the smaller side has at least threshold / (2 - threshold) times the bigrams of the larger, and only if the unit holds
that share of the template's bigrams. So a unit without any of a few words that stand in more than the rest of a
template's bigrams cannot match it, which rules out nearly all units before any bigram is made.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPENING_WORDS = 5
LONG_BIGRAMS = 500  # templates with more are looked for in units long enough for them, the others by their hint words
PASSAGE_WORDS = 40  # templates with at least as many words are also looked for by their opening

# Words of which a unit must hold the same as its licence.
EXACT_WORDS = ["nc", "nd", "noncommercial", "noderivatives", "sa", "sharealike"]

_DISCLAIMER = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
    "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
    "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_THIRD_CLAUSE = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
    "products derived from this software without specific prior written permission."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
    "conditions: The above copyright notice and this permission notice shall be included in all copies or "
    "substantial portions of the Software."
)

# Licences, their opening notices and statements, as they are published.
TEMPLATES = {
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
        "the specific language governing permissions and limitations under the License."
    ),
    "mit-statement": "Released under the MIT License.",
    "mit-notice": _MIT_GRANT,
    "mit": _MIT_GRANT + (
        " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause": _TWO_CLAUSES + _DISCLAIMER,
    "bsd-3-clause": _TWO_CLAUSES + _THIRD_CLAUSE + _DISCLAIMER,
    "gpl-statement": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "lgpl-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-statement": "This work is licensed under the GNU Affero General Public License, version 3.",
}
for _name in ("MIT", "BSD", "ISC", "Apache"):
    for _verb in ("Released", "Licensed"):
        if _name != "Apache" or _verb == "Released":
            TEMPLATES[f"{_name.lower()}-statement-{_verb.lower()}"] = f"{_verb} under the {_name} License."
del TEMPLATES["mit-statement-released"]
for _short, _long in {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial",
    "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}.items():
    TEMPLATES[f"cc-{_short.lower()}-statement"] = f"Licensed under CC {_short} 4.0."
    TEMPLATES[f"cc-{_short.lower()}-notice"] = f"This work is licensed under a Creative Commons {_long} 4.0 International License."
for _file in sorted(Path(__file__).with_name("licenses").glob("*.txt")):
    TEMPLATES[_file.stem] = _file.read_text(encoding="utf-8")


def letter_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def bigrams(words: Column) -> Column:
    """Distinct pairs of neighbouring words."""
    return F.array_distinct(
        F.zip_with(
            F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
            F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
            lambda a, b: F.concat(a, F.lit(" "), b),
        )
    )


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def openings(templates: dict[str, str]) -> dict[str, tuple[str, int]]:
    """Per longer template its opening words and the characters that follow them, all words joined by one space."""
    found = {}
    for name, text in templates.items():
        words = template_words(text)
        if len(words) >= PASSAGE_WORDS:
            opening = " ".join(words[:OPENING_WORDS])
            found[name] = opening, len(" ".join(words)) - len(opening) - 1
    return found


def hint_words(templates: list[list[str]], num: int, den: int) -> list[str]:
    """Words of which every unit holds one that reaches Dice num / den with one of the templates (lists of bigrams).

    A match shares at least num / (2 * den - num) of the template's bigrams. Words are taken, those of most templates
    and the longest first, until they stand in more bigrams of each template than may be missing.
    """
    sets = [[set(g.split(" ")) for g in grams] for grams in templates]
    held = [set().union(*grams) for grams in sets]
    allowed = [len(g) - -(-num * len(g) // (2 * den - num)) for g in sets]
    chosen: set[str] = set()
    for word in sorted(set().union(*held), key=lambda w: (-min(len(w), 6), -sum(w in h for h in held), w)):
        open_ = [i for i, grams in enumerate(sets) if sum(bool(g & chosen) for g in grams) <= allowed[i]]
        if not open_:
            break
        if any(word in held[i] for i in open_):
            chosen.add(word)
    return sorted(chosen)


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    num: int = 4,
    den: int = 5,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, kind, unit, license, common, dice): the licence that a text, or a part of it, resembles most.

    ``kind`` is line, paragraph, text or "passage <template whose opening begins it>", ``unit`` the number of the line,
    paragraph or passage from 0 (text: -1). A unit gives the template of the highest Dice, if that is at least num / den; ties give all.
    A template whose words among ``EXACT_WORDS`` are not those of the unit does not count, so licences that such
    a word tells apart are not taken for each other. A text of one line is scanned once, as a line; paragraphs of
    one line are lines, and a text of one paragraph has none. Null and wordless texts give no row; repeated rows give
    repeated results; no other column is read. Templates are arguments of the plan, so their number should stay in the hundreds.
    """
    chosen = TEMPLATES if templates is None else templates
    known = {name: template_bigrams(t) for name, t in chosen.items()}
    known = {name: grams for name, grams in known.items() if grams}
    if not known:
        kind = docs.schema[id_col].dataType.simpleString()
        return docs.sparkSession.createDataFrame(
            [], f"`{id_col}` {kind}, kind string, unit int, license string, common int, dice double"
        )
    text = F.col(text_col).cast("string")

    def numbered(bodies: Column, kind: str) -> Column:
        return F.transform(bodies, lambda body, i: F.struct(F.lit(kind).alias("kind"), i.alias("unit"), body.alias("body")))

    none = F.array().cast("array<struct<kind:string,unit:int,body:string>>")
    begun = openings({name: chosen[name] for name in known})
    # Distinct bigrams never outnumber words - 1, and w words have at least 2w - 1 characters.
    short = [g for g in known.values() if len(g) <= LONG_BIGRAMS]
    long = [len(g) for g in known.values() if len(g) > LONG_BIGRAMS]
    hints = "|".join(hint_words(short, num, den))

    def possible(body: Column) -> Column:
        """Whether a lower-cased text, or any part of it, may resemble a template."""
        roomy = F.length(body) * (2 * den - num) >= 2 * min(long) * num if long else F.lit(False)
        return roomy | body.rlike(hints) if short else roomy

    def begun_by(plain: Column, opening: str, chars: int) -> Column:
        rests = F.filter(F.split(plain, f" {opening} "), lambda _, i: i > 0)
        return F.transform(rests, lambda rest: F.concat(F.lit(opening + " "), F.substring(rest, 1, chars)))

    def passages(plain: Column) -> Column:
        return F.concat(none, *(numbered(begun_by(plain, *begin), f"passage {name}") for name, begin in begun.items()))

    starts = "|".join(sorted({opening.replace(" ", r"\P{L}+") for opening, _ in begun.values()}))

    # Values used more than once are bound to a lambda variable, as the optimizer would copy them into every use.
    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        return F.flatten(F.transform(F.array(value), body))

    def of_lines(low: Column, lines: Column) -> Column:
        whole = F.array(F.struct(F.lit("text").alias("kind"), F.lit(-1).alias("unit"), low.alias("body")))
        return F.concat(numbered(lines, "line"), F.when(F.size(lines) > 1, whole).otherwise(none))

    def of_blocks(blocks: Column) -> Column:
        several = F.filter(numbered(blocks, "paragraph"), lambda b: F.contains(b["body"], F.lit("\n")))
        return F.when(F.size(blocks) > 1, several).otherwise(none)

    def units_of(low: Column) -> Column:
        plain = F.concat(F.lit(" "), F.array_join(letter_words(low), " "), F.lit(" "))
        found = F.concat(
            let(F.split(low, "\n"), lambda lines: of_lines(low, lines)),
            let(F.split(low, r"\n(?:[ \t\r]*\n)+"), of_blocks),
            F.when(low.rlike(starts), let(plain, passages)).otherwise(none) if begun else none,
        )
        return F.when(possible(low), found).otherwise(none)

    units = (
        docs.filter(text.isNotNull())
        .select(F.col(id_col).alias("_id"), F.explode_outer(let(F.lower(text), units_of)).alias("_u"))
        .filter(F.col("_u").isNotNull())
        .select("_id", "_u.kind", "_u.unit", "_u.body")
    )
    table = F.array(
        *(
            F.struct(
                F.lit(name).alias("license"),
                F.split(F.lit("\n".join(own)), "\n").alias("grams"),
                F.lit(len(own)).alias("size"),
                F.lit(" ".join(sorted(set(EXACT_WORDS) & set(template_words(chosen[name]))))).alias("exact"),
            )
            for name, own in known.items()
        )
    )
    def best_of(unit: Column) -> Column:
        grams, size = unit["grams"], F.size(unit["grams"])
        close = F.filter(
            table,
            lambda t: (size * (2 * den - num) >= t["size"] * num)
            & (t["size"] * (2 * den - num) >= size * num)
            & (t["exact"] == unit["exact"]),
        )

        def told(t: Column) -> Column:
            return F.struct(
                t["license"].alias("license"), F.size(F.array_intersect(grams, t["grams"])).alias("common"), (size + t["size"]).alias("both")
            )

        def kept(tried: Column) -> Column:
            best = F.array_max(F.transform(tried, dice))
            return F.filter(tried, lambda m: (dice(m) == best) & (2 * m["common"] * den >= m["both"] * num))

        return let(F.transform(close, told), kept)

    def dice(m: Column) -> Column:
        return 2 * m["common"] / m["both"]

    every_hint = F.split(F.lit(" ".join(hint_words(list(known.values()), num, den))), " ")

    def of_words(words: Column) -> Column:
        exact = F.array_join(F.array_sort(F.array_intersect(words, F.array(*map(F.lit, EXACT_WORDS)))), " ")
        return F.when(
            F.arrays_overlap(words, every_hint),
            let(F.struct(bigrams(words).alias("grams"), exact.alias("exact")), best_of),
        )

    best = units.filter(possible(F.col("body"))).select(
        "_id", "kind", "unit", F.explode_outer(let(letter_words(F.col("body")), of_words)).alias("m")
    )
    return best.filter(F.col("m").isNotNull()).select(
        F.col("_id").alias(id_col), "kind", "unit", "m.license", "m.common", dice(F.col("m")).alias("dice")
    )
