from __future__ import annotations

import re
import textwrap

from labelloom.llm.license_scan import EXACT_WORDS, TEMPLATES, hint_words, openings, scan_licenses, template_bigrams, template_words
from tests.llm.helpers import docs_frame

NOTICE = TEMPLATES["mit-notice"]
PROSE = "We keep notes about the weather here, and about what the boats brought in."
FULL = ("mit", "isc", "bsd-2-clause", "bsd-3-clause", "apache-2.0", "gpl-2.0", "gpl-3.0", "mpl-2.0")
ROWS = [
    (1, "Some text.\nReleased under the MIT License.\nMore text here."), (2, NOTICE), (3, NOTICE.replace("Software", "Program").upper()),
    (4, "Intro line\n" + NOTICE.replace(". ", ".\n")), (5, None), (6, ""), (7, "1 2 3"), (8, "word " * 30_000),
    (9, "This work is licensed under the GNU General Public License, version 2."), (9, "Released under the MIT license!"),
    (None, "Released under the MIT License."), (10, "under the License"), (11, "Released under the MIT License. " * 40),
    (12, "Permission is hereby granted, free of charge. " * 30 + NOTICE), (13, "\n\n\n"), (14, "Licensed under CC BY-NC-SA 4.0."),
    (15, f"{PROSE}\n \n{textwrap.fill(TEMPLATES['bsd-3-clause'], 60)}\n\n{PROSE}"),
    (16, f"{PROSE} {textwrap.fill(TEMPLATES['mit'], 50)} {PROSE}"),
]


def units(text):
    lines, blocks = text.split("\n"), re.split(r"\n(?:[ \t\r]*\n)+", text)
    yield from (("line", i, line) for i, line in enumerate(lines))
    if len(lines) > 1:
        yield "text", -1, text
    if len(blocks) > 1:
        yield from (("paragraph", i, b) for i, b in enumerate(blocks) if "\n" in b)
    plain = " " + " ".join(template_words(text)) + " "
    for name, (opening, chars) in openings(TEMPLATES).items():
        yield from ((f"passage {name}", i, f"{opening} {rest[:chars]}") for i, rest in enumerate(plain.split(f" {opening} ")[1:]))


def brute(rows, templates, num=4, den=5):
    known = {k: (set(template_bigrams(t)), set(template_words(t)) & set(EXACT_WORDS)) for k, t in templates.items()}
    found = []
    for i, text in rows:
        for kind, unit, body in units(text) if text is not None else []:
            grams, exact = set(template_bigrams(body)), set(template_words(body)) & set(EXACT_WORDS)
            told = {n: (2 * len(grams & own) / (len(grams) + len(own)), len(grams & own)) for n, (own, e) in known.items() if own and e == exact}
            best = max((d for d, _ in told.values()), default=0)
            found += [(i or 0, kind, unit, n, c) for n, (d, c) in told.items() if d == best and best * den >= num]
    return sorted(found)


def test_equals_brute_force(spark):
    got = scan_licenses(docs_frame(spark, ROWS)).collect()
    expected = brute(ROWS, TEMPLATES)
    assert sorted((r.doc_id or 0, r.kind, r.unit, r.license, r.common) for r in got) == expected
    assert {e[0] for e in expected} == {0, 1, 2, 3, 4, 9, 11, 12, 14, 15, 16} and all(0.8 <= r.dice <= 1 for r in got)


def test_full_licences_are_found_wrapped_and_embedded(spark):
    forms = []
    for name in FULL:
        body = TEMPLATES[name]
        forms += [(name, body), (name, textwrap.fill(body, 70)), (name, f"{PROSE}\n" * 40 + f"{textwrap.fill(body, 70)}\n" + f"{PROSE}\n" * 40)]
    got = scan_licenses(docs_frame(spark, [(i, text) for i, (_, text) in enumerate(forms)])).collect()
    for i, (name, _) in enumerate(forms):
        wide = [r for r in got if r.doc_id == i and r.kind != "line" and r.dice > 0.95]
        one_line = [r for r in got if r.doc_id == i and r.dice == 1.0]
        assert name in {r.license for r in wide + one_line}, (i, name)


def test_variants_are_told_apart(spark):
    texts = {
        "cc-by-nc-sa-statement": "Licensed under CC BY-NC-SA 4.0.", "cc-by-nd-statement": "licensed under cc by-nd 3.0",
        "cc-by-statement": "Licensed under CC BY 4.0.", "bsd-statement-released": "Released under the BSD License.",
        "lgpl-statement": "This work is licensed under the GNU Lesser General Public License, version 3.",
        "cc-by-nc-nd-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    }
    got = scan_licenses(docs_frame(spark, list(enumerate(texts.values())))).collect()
    assert sorted((r.doc_id, r.license) for r in got) == list(enumerate(texts))


def test_hint_words_lose_nothing():
    known = [template_bigrams(t) for t in TEMPLATES.values()]
    for num, den in ((4, 5), (1, 2), (9, 10)):
        hints = set(hint_words(known, num, den))
        for grams in known:
            without = sum(not hints & set(g.split(" ")) for g in grams)
            assert 2 * without * den < (without + len(grams)) * num  # even the rest alone, as a unit, is below the threshold


def test_own_templates_ties_and_none(spark):
    own = {"a": "alpha beta gamma", "b": "alpha beta gamma", "void": "..."}
    got = scan_licenses(docs_frame(spark, [(1, "Alpha, BETA gamma")]), own).collect()
    assert sorted((r.license, r.dice) for r in got) == [("a", 1.0), ("b", 1.0)]
    assert scan_licenses(docs_frame(spark, ROWS), {}).count() == 0 and scan_licenses(docs_frame(spark, [])).count() == 0
    texts = spark.createDataFrame([("x", "alpha beta gamma")], "doc_id string, text string")
    assert scan_licenses(texts, {}).schema["doc_id"].dataType == scan_licenses(texts, own).schema["doc_id"].dataType


def test_no_python_in_the_plan(spark):
    plan = scan_licenses(docs_frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
