from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelloom.operators import prepare as P
from labelloom.operators import split as S
from labelloom.plans.slice import PreparedSlice, prepare
from labelloom.schema import FINAL_COLUMNS, NARRATIVE
from tests.conftest import SCHEMA, long_text


def table(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


# (class, texts only it has, copies of its first text); the threshold of a class is five rows.
CLASSES = [(("Loans", "Late fee"), 9, 3), (("Cards", "Fraud"), 5, 0), (("Cards", "Limit"), 4, 1), (("Wires", "Delay"), 3, 0)]
CONTESTED = ["contested narrative number one, long enough", "contested narrative number two, long enough"]


@pytest.fixture(scope="module")
def mixed(spark):
    rows = []
    for (product, issue), own, copies in CLASSES:
        texts = [long_text(f"{product} {issue}", i) for i in range(own)]
        rows += [(text, product, issue) for text in texts + texts[:1] * copies]
    for text in CONTESTED:
        rows += [(text.title(), "Loans", "Late fee"), (f"\t{text}\n", "Cards", "Limit")]
    return table(spark, rows)


def test_each_stage_of_the_funnel_follows_its_rule(mixed):
    sizes = {c: own + copies for c, own, copies in CLASSES}
    for c in (("Loans", "Late fee"), ("Cards", "Limit")):
        sizes[c] += len(CONTESTED)
    large = {c: n for c, n in sizes.items() if n >= 5}
    after = {c: n - len(CONTESTED) * (c in (("Loans", "Late fee"), ("Cards", "Limit"))) for c, n in large.items()}
    kept = {c: n for c, n in after.items() if n >= 5}
    prepared = PreparedSlice(mixed)
    stats = prepared.funnel().first()
    assert stats["rows_raw"] == sum(sizes.values())
    assert stats["n_classes_before_min_count"] == len(sizes) and stats["n_classes_after_min_count"] == len(large)
    assert stats["rows_after_class_filter"] == sum(large.values())
    assert stats["n_conflicting_text_keys_before"] == len(CONTESTED) and stats["n_conflicting_text_keys_after"] == 0
    assert stats["dropped_conflict_rows"] == 2 * len(CONTESTED)
    assert stats["rows_after_conflict_filter"] == sum(after.values())
    assert stats["rows_after_class_refilter"] == stats["rows_after_text_key"] == sum(kept.values())
    rows = prepared.rows()
    assert rows.columns == FINAL_COLUMNS
    assert {tuple(r["category"].split("|")): r["count"] for r in rows.groupBy("category").count().collect()} == kept


def test_ids_follow_source_order(mixed):
    rows = PreparedSlice(mixed).split_rows().orderBy("record_id").select("complaint_id").collect()
    assert [r[0] for r in rows] == [f"cfpb_{i}" for i in range(len(rows))] and rows


def test_nulls_and_short_texts_are_dropped_and_text_is_kept_unstripped(spark):
    padded = "   exactly twenty chars   "
    rows = [(f" {long_text('A', i)} ", "P", "I") for i in range(5)]
    rows += [(None, "P", "I"), (long_text("A", 9), None, "I"), (long_text("A", 9), "P", None), (padded, "P", "I")]
    assert len(padded.strip()) == 20
    kept = prepare(table(spark, rows)).collect()
    assert len(kept) == 5 and all(r["consumer_complaint_narrative"].startswith(" ") for r in kept)


def test_key_kept_in_valid_class_does_not_pull_in_rows_of_dropped_classes(spark):
    rows = [(long_text("A", i), "P", "I") for i in range(5)] + [(long_text("A", 0), "rare", "I")]
    kept = prepare(table(spark, rows))
    assert kept.count() == 5 and kept.select("category").distinct().count() == 1


def test_second_class_filter_is_a_single_pass(spark):
    # Class B falls below five rows only once its conflicting row is gone.
    rows = [(long_text("A", i), "A", "x") for i in range(6)] + [(long_text("B", i), "B", "x") for i in range(4)]
    rows += [(long_text("A", 0), "B", "x")]
    prepared = PreparedSlice(table(spark, rows))
    stats = prepared.funnel().first()
    assert stats["n_classes_after_min_count"] == 2 and stats["n_classes_after_refilter"] == 1
    assert stats["rows_after_conflict_filter"] == 9 and stats["rows_after_class_refilter"] == 5


def test_empty_input(spark):
    prepared = PreparedSlice(spark.createDataFrame([], SCHEMA))
    stats = prepared.funnel().first().asDict()
    assert prepared.rows().count() == 0
    assert {k: v for k, v in stats.items() if v} == {"min_class_count_threshold": 5}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="issue"):
        PreparedSlice(spark.createDataFrame([(1, "t", "p")], "record_id int, consumer_complaint_narrative string, product string"))


def skewed(spark, n=3000):
    """A third of the rows are copies of one text, and one class holds most of the rest."""
    i = F.col("id")
    return spark.range(n).select(
        i.alias("record_id"),
        F.when(i % 3 == 0, "one text copied over and over again in a single class")
        .when(i % 50 == 1, F.concat(F.lit("text shared by classes, block "), (i / 500).cast("int").cast("string")))
        .otherwise(F.concat(F.lit("a text that is written only once, number "), i.cast("string")))
        .alias("consumer_complaint_narrative"),
        F.when(i % 3 == 0, "head").when(i % 7 < 5, "head").otherwise(F.concat(F.lit("p"), (i % 5).cast("string"))).alias("product"),
        F.lit("i").alias("issue"),
    )


def test_slice_equals_the_chain_of_operators_on_skewed_data(spark):
    raw = skewed(spark)
    chain = P.min_text_length(P.drop_null_required(P.select_required(raw)))
    chain = P.derive_digest(P.derive_text_key(P.derive_category(chain)))
    chain = P.class_refilter(P.drop_conflicts(P.min_class_count(chain)))
    chain = P.select_final(P.assign_complaint_id(chain))
    fast = prepare(raw)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, chain.collect()))
    assert 0 < fast.count() < raw.count()


def test_slice_without_any_broadcast_gives_the_same_rows(spark, monkeypatch):
    import labelloom.plans.slice as module
    from labelloom.scale.joins import lookup_join

    expected = sorted(map(tuple, PreparedSlice(skewed(spark)).split_rows().collect()))
    monkeypatch.setattr(
        module, "lookup_join", lambda *a, **k: lookup_join(*a, **k, max_broadcast_rows=0, hot_key_rows=50)
    )
    assert sorted(map(tuple, PreparedSlice(skewed(spark)).split_rows().collect())) == expected


# --- splits -----------------------------------------------------------------------


def test_split_has_no_leakage_and_keeps_all_rows(spark):
    rows = [(long_text(p, i), p, "issue") for p in ("Mortgage", "Debt", "Payday") for i in range(10)]
    prepared = PreparedSlice(table(spark, rows))
    prepared.check()
    split = prepared.split_rows()
    assert split.count() == 30
    sizes = {(r["category"], r["split"]): r["count"] for r in split.groupBy("category", "split").count().collect()}
    assert all(sizes[(f"{p}|issue", "test")] == 2 for p in ("Mortgage", "Debt", "Payday"))
    assert len(sizes) == 9


def test_leakage_is_reported_and_raised(spark):
    df = spark.createDataFrame(
        [("a", "train"), ("a", "val"), ("b", "train"), ("b", "test"), ("c", "val"), ("c", "test"), ("d", "train"), ("a", "test")],
        "key_digest string, split string",
    )
    assert S.split_leakage(df).first().asDict() == {"train_val": 1, "train_test": 2, "val_test": 2}
    with pytest.raises(ValueError, match="shared between splits"):
        S.assert_no_leakage(df)


def groups(spark, n=1200):
    return spark.range(n).select(
        F.sha2(F.col("id").cast("string"), 256).alias("key_digest"),
        F.when(F.col("id") % 3 < 2, "big").otherwise(F.concat(F.lit("c"), (F.col("id") % 20).cast("string"))).alias("category"),
        F.when(F.col("id") % 11 == 0, 3).otherwise(1).cast("long").alias("key_rows"),
    )


def test_folds_are_balanced_within_every_class(spark):
    folds = S.group_stratified_folds(groups(spark))
    counts = folds.groupBy("category").pivot("fold", [0, 1, 2, 3, 4]).count().collect()
    assert all(max(r[1:]) - min(r[1:]) <= 1 for r in counts)


def test_closed_form_of_the_second_deal_equals_dealing_again(spark):
    g = groups(spark)
    got = {r["key_digest"]: r["split"] for r in S.split_groups(g).collect()}
    first = {r["key_digest"]: r["fold"] for r in S.group_stratified_folds(g).collect()}
    rest = g.filter(~F.col("key_digest").isin([k for k, f in first.items() if f == 0]))
    second = {r["key_digest"]: r["fold"] for r in S.group_stratified_folds(rest).collect()}
    want = {k: "test" if f == 0 else ("val" if second[k] == 0 else "train") for k, f in first.items()}
    assert got == want


def test_split_does_not_depend_on_partitioning(spark):
    g = groups(spark)
    once = {tuple(r) for r in S.split_groups(g).collect()}
    assert once == {tuple(r) for r in S.split_groups(g.repartition(13)).collect()}
    assert once != {tuple(r) for r in S.split_groups(g, seed=7).collect()}


def test_hash_split_needs_no_shuffle(spark):
    split = S.hash_group_split(groups(spark))
    assert "Exchange" not in split._jdf.queryExecution().executedPlan().toString()
    shares = {r["split"]: r["count"] / 1200 for r in split.groupBy("split").count().collect()}
    assert abs(shares["test"] - 0.2) < 0.05 and abs(shares["train"] - 0.64) < 0.06


def test_shuffle_is_a_seeded_permutation(spark):
    df = spark.range(200)
    order = [r["id"] for r in S.shuffle(df, "id").collect()]
    assert sorted(order) == list(range(200)) and order != list(range(200))
    assert order == [r["id"] for r in S.shuffle(df.repartition(9), "id").collect()]


def test_unseen_labels(spark):
    df = spark.createDataFrame([("train", "a"), ("val", "a"), ("val", "b"), ("test", "b")], "split string, category string")
    assert sorted(map(tuple, S.unseen_labels(df).collect())) == [("test", "b", 1), ("val", "b", 1)]
    with pytest.raises(ValueError, match="b"):
        S.assert_labels_seen(df)


@pytest.mark.parametrize("small", [True, False])
def test_labels_of_prepared_rows_need_no_text_in_a_shuffle(mixed, monkeypatch, small):
    monkeypatch.setattr("labelloom.plans.slice.fits_broadcast", lambda table: small)
    prepared = PreparedSlice(mixed)
    narrow, whole = prepared.labelled(), prepared.split_rows()
    assert sorted(narrow.collect()) == sorted(whole.select(*narrow.columns).collect()) and narrow.count() > 10
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Project" in line and NARRATIVE in line for line in plan.splitlines())
    joined = whole._jdf.queryExecution().sparkPlan().toString()
    assert ("ShuffledHashJoin" in joined) != small and "SortMergeJoin" not in joined
