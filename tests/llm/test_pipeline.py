from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from labelloom.llm import token_file as T
from labelloom.llm.source_mix import mix_sources
from tests.llm.helpers import edited, linked_groups, shingles
from tests.llm.test_language_id import ODD, text

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two languages, near copies, exact copies, leaks with a replaced word, texts to reject, and repeated rows."""
    rng = random.Random(8)
    rows = []
    for i in range(150):
        lang = "aa" if i % 3 else "bb"
        rows.append([i, text(lang, rng, rng.randint(20, 80)), lang, rng.choice(["s1", "s2", "s3", None])])
    for i in range(30):
        base = rows[rng.randint(0, 20)]
        rows.append([200 + i, base[1] if i % 3 else edited(base[1], 41, 7), base[2], "s1"])
    items = [(i, text("aa", rng, 25)) for i in range(4)] + [(9, None)]
    rows += [[300 + i, rows[i][1] + " " + edited(items[i % 4][1], 11), "aa", "s2"] for i in range(6)]
    rows += [[i, t, lang, None] for i, t, lang in ODD if i != 904] + [rows[3], rows[4]]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*r, None) for r in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, items, folder


@pytest.fixture(scope="module")
def kept(spark, tables, tmp_path_factory):
    """What every stage returned, in order."""
    _, _, folder = tables
    docs, found = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in C.STAGES:
        path = f"{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        found.append(docs)
    return found


def texts(frame):
    return Counter((r.doc_id, r.text) for r in frame.collect())


def test_stages_keep_the_columns_of_documents(kept):
    assert all(frame.columns == ["doc_id", "text", "lang", "source", "n_chars"] for frame in kept[:-1])


def test_only_texts_without_a_language_are_rejected(tables, kept):
    rejected = {900, 901, 902, 903, 905}
    assert texts(kept[0]) == Counter((r[0], r[1]) for r in tables[0] if r[0] not in rejected)


def test_one_document_of_each_group_stays(kept):
    before = sorted(texts(kept[0]), key=lambda r: (r[0] is not None, r[0] or 0))
    groups = linked_groups({k: shingles(t, 5) for k, (_, t) in enumerate(before)}, 80, 100)
    assert texts(kept[1]) == Counter({before[k]: 1 for k in set(groups.values())})


def test_leaking_documents_go(tables, kept):
    def leaks(own):
        for _, item in tables[1]:
            words = (item or "").lower().split()
            for k in range(len(words) - 12):
                for j in range(len(own) - 12):
                    if sum(a == b for a, b in zip(own[j : j + 13], words[k : k + 13])) >= 11:
                        return True
        return False

    expected = Counter({r: n for r, n in texts(kept[1]).items() if not leaks((r[1] or "").lower().split())})
    assert texts(kept[2]) == expected and expected != texts(kept[1])


def test_documents_are_repeated_as_the_mix_says(kept):
    copies = Counter()
    for r in mix_sources(kept[2]).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in kept[3].collect()) == +copies


def test_tokens_and_run(spark, tables, kept):
    rows = sorted(((r.doc_id, r.text) for r in kept[3].collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    tokenizer, start, expected = T.PieceTokenizer(T.default_tokenizer()).tokenizer, 0, []
    for i, t in rows:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        expected.append((i, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted((tuple(r) for r in kept[4].collect()), key=key) == expected
    assert sorted((tuple(r) for r in C.run(spark, tables[2]).collect()), key=key) == expected


def test_empty_table(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    spark.read.parquet(f"{tables[2]}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{tables[2]}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    assert C.run(spark, folder).count() == 0


def test_arrow_batches_of_whole_texts_are_small(spark):
    before = spark.conf.get(C.BATCH)
    try:
        spark.conf.unset(C.BATCH)
        C.prepare(spark)
        assert spark.conf.get(C.BATCH) == C.BATCH_BYTES
    finally:
        spark.conf.set(C.BATCH, before)
