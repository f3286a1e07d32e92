from __future__ import annotations

import random

from labelloom.llm.decontaminate import Seeds, drop_leaking, find_leaks
from tests.llm.helpers import docs_frame, edited

rng = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(400)]


def prose(n):
    return " ".join(rng.choices(VOCABULARY, k=n))


ITEMS = [(i, prose(n)) for i, n in enumerate([40, 30, 13, 14, 9, 6, 5, 4, 1])] + [(50, None), (51, ""), (60, None)]
ITEMS[-1] = (60, ITEMS[0][1].upper())  # a copy of item 0
TEXTS = [
    prose(80), prose(30) + " " + ITEMS[0][1] + " " + prose(20), edited(ITEMS[0][1], 7), edited(ITEMS[0][1], 5, 2), edited(ITEMS[0][1], 3),
    ITEMS[1][1].upper(), prose(5) + "\n" + ITEMS[2][1], edited(ITEMS[2][1], 6), edited(ITEMS[2][1], 4), "x " + ITEMS[4][1], edited(ITEMS[4][1], 9),
    ITEMS[5][1] + " y", ITEMS[6][1], edited(ITEMS[6][1], 5), ITEMS[7][1], ITEMS[8][1], None, "", prose(30_000) + " " + ITEMS[3][1],
    " ".join(ITEMS[0][1].split()[:13]), " ".join(ITEMS[0][1].split()[:12]), (ITEMS[3][1] + " ") * 200,
]


def brute(rows):
    found = set()
    items = {}
    for i, t in ITEMS:
        own = tuple((t or "").lower().split())
        if len(own) >= 5:
            items[own] = min(i, items.get(own, i))
    for d, t in rows:
        own = (t or "").lower().split()
        for item, i in items.items():
            width = min(13, len(item))
            need = -(-width * 4 // 5)
            windows = {item[k : k + width] for k in range(len(item) - width + 1)}
            if any(
                sum(a == b for a, b in zip(own[k : k + width], w)) >= need
                for k in range(len(own) - width + 1) if len(own) < 5_000 or k > 29_000 for w in windows
            ):
                found.add((d, i))
    return found


def frames(spark, rows):
    return docs_frame(spark, rows), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_equals_brute_force(spark):
    rows = list(enumerate(TEXTS))
    found = find_leaks(*frames(spark, rows)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == brute(rows) and len(found) == len({(r.doc_id, r.item_id) for r in found})
    whole = next(r for r in found if r.doc_id == 1)
    assert (whole.doc_start, whole.doc_end, whole.item_start, whole.matched, whole.width, whole.n_items) == (30, 70, 0, 13, 13, 2)


def test_masks_cover_every_choice_of_differing_positions():
    from itertools import combinations

    for width in range(5, 21):
        seed = Seeds(width, 4, 5)
        for places in combinations(range(width), width - seed.need):
            assert any(not set(places) & {j for b in mask for j in seed.blocks[b]} for mask in seed.masks)


def test_clean_rows_stay_as_they_are(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, TEXTS[1]), (None, TEXTS[0]), (0, TEXTS[0])]
    docs, items = frames(spark, rows)
    kept = drop_leaking(docs, items)
    assert kept.columns == docs.columns
    leaking = {TEXTS[d] for d, _ in brute(list(enumerate(TEXTS)))}
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == sorted(str(r) for r in rows if r[1] not in leaking)


def test_empty_tables(spark):
    docs, items = frames(spark, [])
    assert find_leaks(docs, items).count() == 0
    docs, items = frames(spark, [(1, "a b c d e f")])
    assert find_leaks(docs, items.limit(0)).count() == 0 and drop_leaking(docs, items.limit(0)).count() == 1


def test_null_and_repeated_item_ids(spark):
    one, two, three, four = (prose(20) for _ in range(4))
    items = [(None, one), (None, two), (7, three), (7, four), (None, three.upper()), (5, four), (7, four)]
    docs = docs_frame(spark, [(1, one), (2, two), (3, three), (4, four + " " + three), (5, prose(40))])
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.n_items) for r in find_leaks(docs, bench).collect()]
    assert sorted(found, key=str) == [(1, None, 1), (2, None, 1), (3, 7, 2), (4, 5, 3), (4, 7, 2)]
    assert [r.doc_id for r in drop_leaking(docs, bench).collect()] == [5]
    shared = spark.createDataFrame([(7, one), (7, two), (7, two)], "item_id long, text string")
    found = [(r.doc_id, r.item_id, r.n_items) for r in find_leaks(docs, shared).collect()]
    assert sorted(found) == [(1, 7, 1), (2, 7, 2)]
