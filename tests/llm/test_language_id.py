from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from labelloom.llm import language_id as L
from tests.llm.helpers import docs_frame

SYLLABLES = {"aa": ["lor", "em", "ips", "um", "dol"], "bb": ["kra", "zet", "vok", "iny", "est"], "cc": ["oui", "eau", "que", "ment", "é"]}


def text(lang, rng, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n)) + "."


def corpus(n=400):
    rng = random.Random(1)
    return [(i, text(lang, rng), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=n))]


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


ODD = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 %", "bb"), (903, "² ½", "bb"), (None, "lorem dolum", None), (904, "kra" * 40_000, None), (905, "Ωψξ ζηθ λμνπ ρστυφ χψω " * 20, None), (906, "LOREM IPSUM", None)]


@pytest.fixture(scope="module")
def predicted(spark):
    docs = docs_frame(spark, corpus() + ODD + corpus()[:1])
    identifier = L.fit_languages(docs)
    return {r.doc_id: r for r in L.identify_languages(docs, identifier).collect()}, identifier


def test_held_out_accuracy(predicted):
    rows = [r for r in corpus() if held_out(r[0])]
    assert len(rows) > 60 and sum(predicted[0][i].lang_pred == lang for i, _, lang in rows) >= 0.99 * len(rows)


def test_odd_texts(predicted):
    got = predicted[0]
    for i in (900, 901, 902, 903):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, True)
    assert got[None].lang_pred == got[906].lang_pred == "aa" and got[904].lang_pred == "bb"
    assert got[905].lang_pred in SYLLABLES and got[905].rejected
    assert all(0 <= r.score <= 1 for r in got.values())


def test_clean_texts_are_kept(predicted):
    assert not any(predicted[0][i].rejected for i, _, _ in corpus())


def test_held_out_labels_are_not_learned(spark):
    rows = [(i, t, "zz" if held_out(i) else lang) for i, t, lang in corpus(120)]
    assert "zz" not in L.fit_languages(docs_frame(spark, rows)).models.languages


def brute(words, lang_words):
    """Interpolated Kneser-Ney by definition, with dictionaries of strings."""
    longest = L.gram_counts(Counter(lang_words))
    levels = [Counter() for _ in range(L.ORDER)]
    for g, n in longest.items():
        levels[len(g) - 1][g] += n
    for order in range(L.ORDER - 1, 0, -1):
        for g in levels[order]:
            levels[order - 1][g[1:]] += 1

    def p(gram):
        if not gram:
            return 1 / (len(levels[0]) + 1)
        counts = levels[len(gram) - 1]
        ones, twos = (sum(n == k for n in counts.values()) for k in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        after = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not after:
            return p(gram[1:])
        total = sum(after.values())
        return max(counts.get(gram, 0) - d, 0) / total + d * len(after) / total * p(gram[1:])

    out = []
    for word in words:
        whole = L._START + word + L._END
        out.append(sum(math.log(p(whole[max(0, e - L.ORDER) : e])) for e in range(2, len(whole) + 1)))
    return out


def test_probabilities_equal_the_definition():
    learned = {"x": ["abba", "abc", "cab", "abba", "a"], "y": ["dede", "ded", "abed"]}
    models = L.LanguageModels({k: L.gram_counts(Counter(v)) for k, v in learned.items()})
    words = ["abba", "a", "zzz", "bed", "abcabcabc"]
    got = models.log_probabilities(words)
    for column, lang in enumerate(models.languages):
        assert np.allclose(got[:, column], brute(words, learned[lang]))


def test_nothing_to_learn_and_empty_table(spark):
    docs = docs_frame(spark, [(1, "some words", None)])
    row = L.identify_languages(docs, L.fit_languages(docs)).first()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
    empty = docs_frame(spark, [])
    assert L.identify_languages(empty, L.fit_languages(empty)).count() == 0
    assert L.keep_identified(empty).columns == empty.columns


def test_rejected_rows_go_and_columns_stay(spark):
    docs = docs_frame(spark, corpus() + ODD)
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids >= {i for i, _, _ in corpus()} and not ids & {900, 901, 902, 903, 905}


def test_new_words_are_scored_in_bounded_memory():
    rng = random.Random(4)
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrst", k=8)) for _ in range(n)) for n in (300, 20_000)]
    scorer = L.Scorer(L.LanguageModels({lang: dict(L.gram_counts(Counter(words[0].split()))) for lang in ("aa", "bb", "cc", "dd")}))
    tracemalloc.start()
    scorer.entropies([words[1]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 15 << 20


def test_a_text_leaves_the_jvm_once(spark):
    docs = docs_frame(spark, corpus(120))
    kept = L.keep_identified(docs)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan and "MapInArrow" in plan
    told = L.identify_languages(docs, L.fit_languages(docs)).filter("not rejected")
    assert sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(r[0] for r in told.select("doc_id").collect())


def test_a_worker_remembers_a_bounded_number_of_words():
    models = L.LanguageModels({lang: dict(L.gram_counts(Counter(words.split()))) for lang, words in (("aa", "one two"), ("bb", "uno dos"))})
    scorer = L.Scorer(models)
    for low in range(0, 150_000, 10_000):
        text = " ".join("".join(chr(97 + int(d)) for d in str(n)) for n in range(low, low + 10_000))
        found = scorer.entropies([text])
    assert len(scorer.index) <= 100_000 and len(scorer.rows) <= 210_000
    alone = L.Scorer(models).entropies([text])
    assert all((a == b).all() for a, b in zip(found, alone))
