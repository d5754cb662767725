"""Mixing sources to target weights (DataFrame functions only).

Every row gets a hash-random key. Rows are range-sorted by (source, key), token counts are summed per source and range, ranges
get the sums before them, and the running sum inside a range tells which part of a row lies within the budget of its source:
whole epochs first, then the rows with the smallest keys up to the exact budget, the last one cut where the budget ends.

Defined results: null text has size 0; a null source is a source of its own, ordered last; rows of size 0 take nothing; repeated
rows have one key and are numbered one after the other; an empty table gives an empty result. A key decides alone, so reruns
and recomputed tasks agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import SPACE, SPACE_CHARS, ranked, row_key, stage, text_of

FULL = "_b_full"


def word_count(c):
    body = F.btrim(c, F.lit(SPACE_CHARS))
    return F.when(F.length(body) == 0, 0).otherwise(F.size(F.split(body, f"[{SPACE}]+", -1))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) to targets: ``share`` of all sizes split by weight, at most ``cap`` times a source's size.

    Weights repeat over the sources in code-point order. While a source is above its cap, it stops there and the rest is shared
    anew by weight; each round is one aggregate over the sources, and only three numbers come to the driver.
    """
    s = ranked(sizes, [F.col("source").asc_nulls_last()], "_b_rank")
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_b_rank") % len(weights) + 1).cast("int"))
    s = stage(s.withColumn("weight", weight), "sources")
    most = F.col("source_size") * F.lit(cap)
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * share
    level, stopped = 0.0, -1
    while True:
        at = most <= F.lit(level) * F.col("weight")
        n, held, free = s.agg(F.count(F.when(at, 1)), F.sum(F.when(at, most)), F.sum(F.when(~at, F.col("weight")))).first()
        if n == stopped or not free:
            break
        level, stopped = (total - (held or 0.0)) / free, n
    return s.select("source", "source_size", "weight", "_b_rank", F.least(most, F.lit(level) * F.col("weight")).alias("target"))


def mix(
    docs: DataFrame, seed: int = 7, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", keep: list[str] | None = None,
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken, and the columns of ``keep``."""
    t = text_of(F.col(text))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.lit(":"), F.md5(t))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(t).alias("size"), F.md5(name).alias("_b_key"), *(keep or []))
    rows = stage(rows, "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = stage(source_targets(sizes, weights, share, cap), "targets")
    with_goal = rows.alias("r").join(goal.withColumnRenamed("source", "_b_source"), F.col("source").eqNullSafe(F.col("_b_source"))).drop("_b_source")

    order = ["_b_rank", "_b_key"]
    spread = stage(with_goal.repartitionByRange(*order).withColumn("_b_part", F.spark_partition_id()), "spread")
    before = spread.groupBy("_b_rank", "_b_part").agg(F.sum("size").alias("_b_sum"))
    run = Window.partitionBy("_b_rank").orderBy("_b_part")
    before = before.select("_b_rank", "_b_part", (F.sum("_b_sum").over(run) - F.col("_b_sum")).alias("_b_before"))
    inside = Window.partitionBy("_b_rank", "_b_part").orderBy("_b_key").rowsBetween(Window.unboundedPreceding, 0)
    out = spread.withColumn("_b_inside", F.sum("size").over(inside) - F.col("size")).join(F.broadcast(before), ["_b_rank", "_b_part"])
    budget = F.floor("target")
    out = out.withColumn(FULL, F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
    rest = budget - F.col(FULL) * F.col("source_size") - F.col("_b_before") - F.col("_b_inside")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    taken = F.col(FULL) * F.col("size") + part
    return out.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *(keep or []))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, the last copy cut after the words that the budget holds.

    Columns are those of ``docs``; ``n_chars``, where there, follows the cut text. Null texts and texts without words are not taken.
    """
    columns = docs.columns
    keyed = docs.select("*", *row_key(*[F.col(c) for c in columns]))
    taken = mix(keyed, keep=["_b_k1", "_b_k2"], **options)
    # Equal rows share a key, so one narrow row per key meets the texts in their only shuffle. At most one row of a source is cut, so the
    # sum over equal rows says what each takes: all of them whole epochs, the first ones one more, one of them the part that is left.
    per_key = taken.groupBy("_b_k1", "_b_k2").agg(F.sum("taken").alias("_b_sum"), F.count("*").alias("_b_n"), F.max("size").alias("_b_size"))
    both = keyed.join(per_key.filter("_b_sum > 0"), ["_b_k1", "_b_k2"])
    nth = F.row_number().over(Window.partitionBy("_b_k1", "_b_k2").orderBy(F.lit(1)))
    epochs = F.expr("_b_sum div (_b_n * _b_size)")
    rest = F.col("_b_sum") - F.col("_b_size") * (epochs * F.col("_b_n") + F.col("_b_nth_row") - 1)
    part = F.greatest(F.lit(0), F.least(F.col("_b_size"), rest))
    both = both.withColumn("_b_nth_row", nth).withColumn("_b_taken", epochs * F.col("_b_size") + part).filter("_b_taken > 0")
    cut = F.col("_b_taken") % F.col("_b_size")
    copies = F.ceil(F.col("_b_taken") / F.col("_b_size")).cast("int")
    both = both.withColumn("_b_nth", F.explode(F.sequence(F.lit(1), copies)))
    pattern = F.concat(F.lit(f"^(?:[{SPACE}]*+[^{SPACE}]++){{"), cut.cast("string"), F.lit("}+"))
    first = F.call_function("regexp_substr", F.col("text"), pattern)
    text = F.when((F.col("_b_nth") == copies) & (cut > 0), first).otherwise(F.col("text"))
    both = both.withColumn("_b_text", text)
    values = {"text": F.col("_b_text"), "n_chars": F.length("_b_text").cast("long")}
    return both.select(*[values.get(c, F.col(c)).alias(c) for c in columns])
