"""Mixing sources to target weights by entropy balancing.

Sources get token targets by weight, none above ``most`` times what it holds. Document rates r stay as close to 1 as
possible in relative entropy, subject to sum(r * size) = target in every source and r <= most. The
solution of that convex problem is r = min(most, exp(lambda * size / mean size)), with one multiplier per source: the root of the dual's
gradient. Newton steps on it run for all sources at once; each is one aggregation over (source, size, rows)
and touches no text. Sums are taken in fixed point, so reruns agree to the last bit.

Rates become whole copies inside cells of a few thousand rows of one source, largest documents first: each gets
the floor or the ceiling of its rate, whichever brings the words taken so far nearer to the words due so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelloom.llm.rows import whole_row
from labelloom.scale.joins import lookup_join
from labelloom.scale.ordering import ordered_index
from labelloom.scale.staging import StagingScope

WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 2_000
NEWTON_STEPS = 60
CLOSE = 1e-9
_FIXED = "decimal(38,6)"


def text_size(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(per_source: DataFrame, weights: list[int], most: int, scope: StagingScope) -> DataFrame:
    """Add ``target``: all sizes shared by weight, the excess over ``most`` times a source's size shared again.

    Weights repeat over the sources in code point order, null last. Each turn finds the sources whose share at the
    present level exceeds their bound, in exact integers, and lowers what is left to share by these bounds.
    """
    ranked = ordered_index(per_source, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = scope.stage(ranked.withColumn("weight", weight.cast("decimal(10,0)")).drop("_rank"), "sources")
    bound = F.col("source_size").cast("decimal(20,0)") * most
    left, share = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    left, share = int(left or 0), int(share or 1)
    capped = 0
    while True:
        above = F.col("weight") * F.lit(left).cast("decimal(20,0)") > bound * F.lit(share).cast("decimal(8,0)")
        total, n, bounds, weight_in = rows.agg(
            F.sum("source_size"), F.count_if(above), F.sum(F.when(above, bound)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == capped:
            break
        capped, left, share = n, int(total - bounds), int(weight_in or 1)
    exact = F.col("weight").cast("double") * F.lit(left).cast("double") / F.lit(share).cast("double")
    return rows.withColumn("target", F.when(above, bound.cast("double")).otherwise(exact)).drop("weight")


def document_rates(histogram: DataFrame, targets: DataFrame, most: int, scope: StagingScope) -> DataFrame:
    """(key, multiplier): the dual solution of every source. ``histogram``: (key, size, n); ``targets``: (key, target, source_size, n_docs)."""
    mean = F.col("source_size") / F.col("n_docs")
    room = F.col("target") / F.col("source_size")
    # With multiplier x, every size of at least 1 has a rate of at most exp(x / mean) for x < 0, at least for x > 0.
    far = mean * F.greatest(F.abs(F.log(room)), F.lit(math.log(most)))
    state = targets.filter((F.col("source_size") > 0) & (F.col("target") > 0)).select(
        "key", "target", mean.alias("mean"), F.lit(0.0).alias("at"),
        F.when(room < 1, -far).otherwise(F.lit(0.0)).alias("low"),
        F.when(room < 1, F.lit(0.0)).otherwise(far).alias("high"),
        (room >= most * (1 - CLOSE)).alias("full"),
    )
    state = scope.stage(state, "dual-0")
    for step in range(1, NEWTON_STEPS + 1):
        exponent = F.col("at") * F.col("size") / F.col("mean")
        free = exponent < math.log(most)
        rate = F.when(free, F.exp(F.least(exponent, F.lit(math.log(most))))).otherwise(F.lit(float(most)))
        words = F.col("n") * F.col("size") * rate
        slope = F.when(free, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = histogram.join(state, "key").groupBy("key").agg(
            F.sum(words.cast(_FIXED)).cast("double").alias("words"), F.sum(slope.cast(_FIXED)).cast("double").alias("slope")
        )
        found = state.join(sums, "key")
        ratio = F.col("words") / F.col("target")
        low = F.when(ratio <= 1, F.col("at")).otherwise(F.col("low"))
        high = F.when(ratio >= 1, F.col("at")).otherwise(F.col("high"))
        newton = F.col("at") - F.log(ratio) * F.col("words") / F.col("slope")
        inside = (F.col("slope") > 0) & (ratio > 0) & (newton > low) & (newton < high)
        done = (F.abs(ratio - 1) < CLOSE) | F.col("full")
        state = scope.stage(
            found.select(
                "key", "target", "mean",
                F.when(done, F.col("at")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("at"),
                low.alias("low"), high.alias("high"), "full", done.alias("done"),
            ),
            f"dual-{step}",
        )
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("key", F.col("mean").alias("_mean"), F.col("at").alias("_at"), F.col("full").alias("_full"))


def _rounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies of rows sorted by (key, cell) and falling size."""
    cell, due = None, 0.0
    for batch in batches:
        table = batch.to_pydict()
        copies = []
        for key, part, size, rate in zip(table["key"], table["cell"], table["size"], table["rate"]):
            if (key, part) != cell:
                cell, due = (key, part), 0.0
            few = math.floor(rate)
            due += rate * size
            n = few if rate == few or abs(due - few * size) <= abs(due - (few + 1) * size) else few + 1
            due -= n * size
            copies.append(n)
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in range(4)] + [pa.array(copies, pa.int64())], names=["id", "source", "key", "size", "copies"]
        )


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken), one row per row of ``docs``.

    Null texts have size 0 and are never taken; a null source is a source, the last in order. Rows that repeat an id are documents of
    their own. Copies lie in 0..most. Only ids, sources and word counts are shuffled; a source may hold any
    share of the rows, because it is cut into cells.
    """
    scope = StagingScope(docs.sparkSession, "mix")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    sizes = scope.stage(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).alias("source"), text_size(F.col(text_col)).alias("size")
        ).withColumn("key", key),
        "sizes",
    )
    histogram = scope.stage(sizes.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "histogram")
    per_source = histogram.groupBy("key", "source").agg(
        F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("n_docs")
    )
    targets = scope.stage(source_targets(per_source, list(weights), most, scope), "targets")
    rates = document_rates(histogram.filter(F.col("size") > 0).drop("source"), targets, most, scope)
    known = scope.stage(targets.drop("source").join(rates, "key", "left"), "known")
    rows = lookup_join(sizes, known, "key", "left", "n_docs", F.col("id"))
    exponent = F.least(F.col("_at") * F.col("size") / F.col("_mean"), F.lit(math.log(most)))
    rate = F.when(F.col("_full"), F.lit(float(most))).otherwise(F.coalesce(F.exp(exponent), F.lit(0.0)))
    cells = F.ceil(F.col("n_docs") / CELL_ROWS)
    rated = rows.select(
        "id", "source", "key", "size",
        F.when(F.col("size") > 0, F.least(rate, F.lit(float(most)))).otherwise(0.0).alias("rate"),
        F.pmod(F.xxhash64("id"), cells).cast("long").alias("cell"),
    )
    dealt = rated.repartition("key", "cell").sortWithinPartitions("key", "cell", F.desc("size"), F.xxhash64("id"), "id")
    schema = f"id {dict(sizes.dtypes)['id']}, source string, key string, size long, copies long"
    copied = dealt.mapInArrow(_rounded, schema)
    bounds = known.select("key", "source_size", "target", "n_docs")
    return lookup_join(copied, bounds, "key", "left", "n_docs", F.col("id")).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def repeat_documents(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every row as often as ``mixed`` says. Rows that share an id are matched by word count."""
    turn = Window.partitionBy("_id").orderBy("_size")
    left = docs.select(whole_row(docs), F.col(id_col).alias("_id"), text_size(F.col(text_col)).alias("_size"))
    left = left.withColumn("_no", F.row_number().over(turn))
    right = mixed.select(F.col(id_col).alias("_rid"), F.col("size").alias("_size"), "copies")
    right = right.withColumn("_rno", F.row_number().over(Window.partitionBy("_rid").orderBy("_size", "copies"))).drop("_size")
    joined = left.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_no") == F.col("_rno")))
    return (
        joined.filter(F.col("copies") > 0)
        .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
        .select("row.*")
    )
