from __future__ import annotations

import random
from pathlib import Path

from labelloom.llm import linking
from labelloom.llm.paragraph_dedup import bands_for, remove_paragraphs, repeated_paragraphs, repeated_text
from labelloom.scale.staging import shared_dir
from tests.llm.helpers import docs_frame, edited, linked_groups, shingles

rng = random.Random(21)


def prose(n):
    return " ".join(f"w{rng.randint(0, 2000)}" for _ in range(n))


BASES = [prose(n) for n in (60, 80, 30, 25, 120)]
SHORT = prose(10)


def corpus():
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(26, 70)), SHORT]
        if i % 3 == 0:
            parts.insert(rng.randint(0, 2), BASES[0])
        if i % 4 == 0:
            parts.append(edited(BASES[i % 5], rng.choice([40, 61, 130]), i % 7))
        if i % 10 == 0:
            parts += [parts[-1], "", prose(24)]
        rows.append((i, "\n".join(parts)))
    rows += [(100, None), (101, ""), (102, "\n".join([BASES[1]] * 50)), (103, prose(20_000)), (104, BASES[2].upper()), (105, "é ü " + BASES[4])]
    return rows


def brute(rows):
    sets = {(d, k): shingles(line, 5) for d, t in rows if d is not None for k, line in enumerate((t or "").split("\n")) if len(line.split()) >= 25}
    groups = linked_groups(sets, 4, 5)
    return {p: g for p, g in groups.items() if p != g}


def test_equals_brute_force(spark):
    rows = corpus()
    found = repeated_paragraphs(docs_frame(spark, [*rows, (None, BASES[0])])).collect()
    assert {(r.doc_id, r.para): (r.kept_id, r.kept_para) for r in found} == brute(rows)
    texts = dict(rows)
    for r in found:
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.para]


def test_paragraphs_are_removed_and_other_columns_stay(spark):
    rows = corpus()
    docs = docs_frame(spark, [*rows, (None, BASES[0])])
    out = remove_paragraphs(docs, repeated_paragraphs(docs))
    assert out.columns == docs.columns
    gone = brute(rows)
    expected = {d: t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    got = {r.doc_id: r.text for r in out.collect()}
    assert got.pop(None) == BASES[0] and got == expected


def test_a_repeated_id_is_one_document(spark):
    rows = [(7, BASES[0]), (7, BASES[0]), (8, BASES[0])]
    assert [(r.doc_id, r.kept_id) for r in repeated_paragraphs(docs_frame(spark, rows)).collect()] == [(8, 7)]


def test_bands_give_the_asked_recall():
    bands, rows = bands_for(0.8)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 128 and rows >= 4


def test_empty_table(spark):
    docs = docs_frame(spark, [])
    assert repeated_paragraphs(docs).count() == 0 and remove_paragraphs(docs, repeated_paragraphs(docs)).count() == 0


def wrapped(text, size=12):
    own = text.split()
    return "\n".join(" ".join(own[i : i + size]) for i in range(0, len(own), size))


def test_passages_inside_longer_lines_and_across_line_ends(spark):
    passage, verse = prose(60), prose(40)
    rows = [
        (1, prose(70) + " " + passage + " " + prose(40)), (2, "é " + prose(90) + " " + passage.upper() + " " + prose(35)),
        (3, prose(30) + "\n" + wrapped(prose(20) + " " + passage) + "\n" + prose(30)), (4, wrapped(verse) + "\n\n" + prose(30)),
        (5, prose(30) + "\n" + wrapped(verse)), (6, prose(45) + " " + " ".join(passage.split()[:49])), (7, "word " * 400), (8, None),
        (9, passage.split()[0] + " " + prose(80) + " " + passage + " " + prose(80) + " " + passage),
    ]
    docs = docs_frame(spark, [*rows, rows[1], (None, passage)])
    found, texts = repeated_text(docs), dict(rows)
    cut = {}
    for r in found.collect():
        cut.setdefault((r.doc_id, r.kept_id), set()).add(" ".join(texts[r.doc_id][r.start : r.start + r.length].lower().split()))
    assert cut == {(2, 1): {passage}, (3, 1): {passage}, (9, 1): {passage}, (5, 4): {verse}, (7, 7): {" ".join(["word"] * 350)}}
    left = {r.doc_id: r.text for r in remove_paragraphs(docs, found).collect()}
    assert left[1] == texts[1] and left[6] == texts[6] and left[8] is None
    assert left[2] == " ".join(texts[2].split()[:91]) + "  " + " ".join(texts[2].split()[-35:])
    assert left[5] == texts[5].split("\n")[0] and len(left[7].split()) == 50
    assert left[3].split() == texts[3].split()[:50] + texts[3].split()[-30:]


def test_profiles_are_let_go_before_passages(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("paragraphs-*"))
    found = repeated_text(docs_frame(spark, [(0, BASES[0]), (1, "\n".join([BASES[0], BASES[4]])), (2, BASES[4])]))
    assert {(r.doc_id, r.para, r.kept_id) for r in found.collect()} == {(1, 0, 0), (2, 0, 1)}
    assert set(folder.glob("paragraphs-*")) == before


def test_a_crowd_of_near_copies_leaves_few_pairs_to_the_last_join(spark, monkeypatch):
    """400 copies with two words changed each: a tenth of all pairs link, and no copy links with all others."""
    base, rows, tried = [f"b{i}" for i in range(100)], [], {}
    for i in range(400):
        at = rng.randint(0, 98)
        rows.append((i, " ".join([*base[:at], f"x{i}", f"y{i}", *base[at + 2 :]])))
    verified = linking._verified

    def counted(pairs, *args, **more):
        tried[args[5]] = pairs.count()
        return verified(pairs, *args, **more)

    monkeypatch.setattr(linking, "_verified", counted)
    found = repeated_paragraphs(docs_frame(spark, rows)).collect()
    assert {(r.doc_id, r.para): (r.kept_id, r.kept_para) for r in found} == brute(rows)
    assert tried.get("paras-rest", 0) < 800
    print(tried)
