"""Evaluation: detection, correction ranks, paired significance, margin sweeps, by groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the power of two by which the sign test's terms are scaled down.
SHIFT = 400


def _rate(a: Column, b: Column) -> Column:
    return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)


def detection(rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and rates of rows (is_error, flagged), by the columns in `by`; empty denominators give 0."""
    e, f = F.col("is_error"), F.col("flagged")
    g = rows.groupBy(*by).agg(F.count_if(e & f).alias("tp"), F.count_if(e & ~f).alias("fn"), F.count_if(~e & f).alias("fp"), F.count_if(~e & ~f).alias("tn"))
    tp, fn, fp, tn = (F.col(x) for x in ("tp", "fn", "fp", "tn"))
    return g.select(*by, "tp", "fn", "fp", "tn", _rate(tp, tp + fp).alias("precision"), _rate(tp, tp + fn).alias("recall"), _rate(2 * tp, 2 * tp + fp + fn).alias("f1"), _rate(tn, tn + fp).alias("specificity"), _rate(tp + tn, tp + fn + fp + tn).alias("accuracy"))


def correction(rows: DataFrame, *by: str, depth: int = 10) -> DataFrame:
    """top1, top3, top5, top10, mrr and never of rows (rank: of the right word, null if absent); ranks past depth count as absent."""
    r = F.when(F.col("rank") <= depth, F.col("rank"))
    share = lambda c: F.round(F.avg(c), 6)
    top = [share(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"top{k}") for k in (1, 3, 5, 10)]
    return rows.groupBy(*by).agg(F.count("*").alias("items"), *top, share(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"), F.count_if(r.isNull()).alias("never"))


def by_kind(rows: DataFrame, kind: str = "kind", prefix: int | None = None) -> DataFrame:
    """correction by kind (or its first letters), and one row of all (kind null)."""
    k = F.substr(kind, F.lit(1), F.lit(prefix)) if prefix else F.col(kind)
    out = rows.withColumn(kind, k)
    return correction(out, kind).unionByName(correction(out).withColumn(kind, F.lit(None).cast("string")))


def running_text(flags: DataFrame) -> DataFrame:
    """Token and sentence flag rates of rows (sentence, flagged)."""
    s = flags.groupBy("sentence").agg(F.count("*").alias("n"), F.count_if(F.col("flagged")).alias("f"))
    return s.agg(F.sum("n").alias("tokens"), F.sum("f").alias("flagged"), _rate(F.sum("f"), F.sum("n")).alias("token_rate"), _rate(F.count_if(F.col("f") > 0), F.count("*")).alias("sentence_rate"))


def paired(before: DataFrame, after: DataFrame, key: str = "item") -> DataFrame:
    """One row (fixed, broken) of two runs (key, right)."""
    j = before.select(key, F.col("right").alias("b")).join(after.select(key, F.col("right").alias("a")), key)
    return j.agg(F.count_if(~F.col("b") & F.col("a")).alias("fixed"), F.count_if(F.col("b") & ~F.col("a")).alias("broken"))


def sign_test(rows: DataFrame, wins: str = "fixed", losses: str = "broken") -> DataFrame:
    """rows with p_value: exact two-sided binomial, by a running product of ratios (no factorials).

    Terms outgrow doubles from some 1,000 items on, so term and sum are held as multiples of 2 ** shift.
    """
    n, k = F.col(wins) + F.col(losses), F.least(wins, losses)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"), F.lit(0).cast("long").alias("shift"))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def step(a: Column, i: Column) -> Column:
        large = a["term"] > 2.0**SHIFT
        down, shift = F.when(large, F.lit(2.0**-SHIFT)).otherwise(1.0), a["shift"] + F.when(large, SHIFT).otherwise(0)
        t = a["term"] * down * ((n - i + 1) / i)
        return F.struct(t.alias("term"), (a["sum"] * down + t).alias("sum"), shift.cast("long").alias("shift"))

    tail = F.aggregate(steps, start, step, lambda a: a["sum"] * F.pow(F.lit(2.0), a["shift"] - n))
    return rows.withColumn("p_value", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 9))


def margin_sweep(flags: DataFrame, margins: list[float]) -> DataFrame:
    """By margin: false flags of clean tokens, recall and precision of rows (is_error, right, gain or null)."""
    rows = flags.select("is_error", "right", "gain", F.explode(F.array(*map(F.lit, margins))).alias("margin"))
    hit = F.coalesce(F.col("gain") >= F.col("margin"), F.lit(False))
    g = rows.groupBy("margin").agg(F.count_if(~F.col("is_error") & hit).alias("false_flags"), F.count_if(~F.col("is_error")).alias("clean"), F.count_if(F.col("is_error") & hit & F.col("right")).alias("caught"), F.count_if(F.col("is_error")).alias("errors"), F.count_if(hit).alias("flags"))
    return g.select("margin", "false_flags", _rate(F.col("false_flags"), F.col("clean")).alias("false_rate"), _rate(F.col("caught"), F.col("errors")).alias("recall"), _rate(F.col("caught"), F.col("flags")).alias("precision"))


def partitioned(rows: DataFrame) -> DataFrame:
    """correction over all combinations of reachable and legal (null: all)."""
    r = F.when(F.col("rank") <= 10, F.col("rank"))
    return rows.cube("reachable", "legal").agg(F.count("*").alias("items"), F.round(F.avg(F.when(r == 1, 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.avg(F.when(r <= 5, 1.0).otherwise(0.0)), 6).alias("top5"), F.round(F.avg(F.coalesce(1.0 / r, F.lit(0.0))), 6).alias("mrr"))


def tag_agreement(rows: DataFrame) -> DataFrame:
    """(tag, n, agreement) of rows (tags, agrees); all rows under the tag null."""
    each = rows.select(F.explode("tags").alias("tag"), "agrees").unionByName(rows.select(F.lit(None).cast("string").alias("tag"), "agrees"))
    return each.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg(F.col("agrees").cast("int")), 6).alias("agreement"))


def shapes(rejected: DataFrame, shape: Column, top: int = 20) -> DataFrame:
    """(shape, words, occurrences, examples): rejected words (word, count) grouped by structure, most frequent examples."""
    r = rejected.withColumn("shape", shape)
    w = Window.partitionBy("shape").orderBy(F.desc("count"), "word")
    ex = r.withColumn("n", F.row_number().over(w)).where(F.col("n") <= top).groupBy("shape").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("e"))
    return r.groupBy("shape").agg(F.count("*").alias("words"), F.sum("count").alias("occurrences")).join(ex.select("shape", F.col("e.word").alias("examples")), "shape")


def negative_sample(words: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n distinct words of the smallest seeded hash."""
    return words.select("word").distinct().orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(n)
