"""Quality rules with adaptive thresholds, DataFrame and SQL functions only.

Base counts come from whole texts. Four rates of each document (symbols, word length, repeated lines, repeated words) go
into quantile sketches of every language and source: a rate's bucket is its seven leading bits, a sketch the counts of its
buckets, so sketches merge by adding up, exactly and in any order, with a relative error below 1 / 64 and map-side
combining. A group's quantiles are drawn towards those of its parent (a source's to its language's, a language's to all
documents'), which weigh as much as `weight` rows; there is no size from which a group stands alone. The upper fence of a
rate is its median plus the largest of `k` times (median - first decile), `k` times (third quartile - median) and a small
floor well under the base rules' cutoffs; word length has a lower fence of the same width.

Scale: the texts are read once and the counts written to the shared folder; a group's shuffle is its buckets, not its rows,
so a hot source costs no more than another; the join's rows of a hot source can be split.

Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own. Repeated
rows count each; long texts are read whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# rate: (k, least width of the fence, has a lower fence too)
RULES = {"symbols": (6, 100, False), "word_length": (6, 80, True), "line_repeats": (6, 200, False), "word_repeats": (6, 200, False)}
WEIGHT = 200  # rows that a parent's quantiles count for
QUANTILES = {"low": 10, "mid": 50, "high": 75}  # per cent


def counts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Base counts of each row: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(F.col(id_col).alias("id"), *more, text.alias("t"))
    a = a.select("*", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+"), "").alias("words"), F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0).alias("lines"))
    plain = [c for c in a.columns if c not in ("t", "words", "lines")]
    a = a.select(
        *plain, F.size("words").alias("n_words"), F.length(F.translate("t", SPACE, "")).alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(F.size("words") > 2, F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))), 1, F.size("words") - 2)).alias("windows"),
    )
    # only texts with a repeated window are sorted
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    a = a.withColumn("sorted", F.when(again, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce((x["h"] == F.get("sorted", j + 1)["h"]) | F.when(j > 0, x["h"] == F.get("sorted", j - 1)["h"]), F.when(j > 0, x["h"] == F.get("sorted", j - 1)["h"]), F.lit(False))
    a = a.withColumn("hit", F.when(F.col("sorted").isNotNull(), F.transform(F.filter("sorted", same), lambda x: x["i"])))
    covered = F.size(F.array_distinct(F.concat("hit", F.transform("hit", lambda i: i + 1), F.transform("hit", lambda i: i + 2))))
    return a.select(*plain, *(F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")), F.when(F.col("hit").isNotNull(), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def rates() -> dict[str, str]:
    return {
        "symbols": "10000 * n_symbols div greatest(word_chars, 1)", "word_length": "100 * word_chars div greatest(n_words, 1)",
        "line_repeats": "1000 * n_dup_lines div greatest(n_lines, 1)", "word_repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
    }


def bucket(x: str) -> str:
    """The lower end of x's bucket: x with all but its seven leading bits cleared."""
    return f"shiftleft(shiftright({x}, greatest(length(bin({x})) - 7, 0)), greatest(length(bin({x})) - 7, 0))"


def sketches(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, bucket, n): the sketch of each rate for each group."""
    each = rows.select(*by, F.explode(F.create_map(*[x for k, e in rates().items() for x in (F.lit(k), F.expr(e))])).alias("rate", "value"))
    return each.groupBy(*by, "rate", F.expr(bucket("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, by: list[str]) -> DataFrame:
    return sketch.groupBy(*by, "rate", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(by, rate, total, low, mid, high): the quantiles of each sketch, as lower ends of buckets."""
    w = Window.partitionBy(*by, "rate")
    s = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("total") * share, F.col("bucket"))).alias(name) for name, share in QUANTILES.items()]
    return s.groupBy(*by, "rate").agg(F.max("total").alias("total"), *at)


def fences(rows: DataFrame, lang: str, source: str, weight: int = WEIGHT) -> DataFrame:
    """(lang, source, <rate>_most, <rate>_least ...): one row for each group."""
    own = materialize(sketches(rows, [lang, source]), "sketch")
    q = quantiles(own, [lang, source])
    names = ("total", *QUANTILES)
    by_lang = quantiles(merged(own, [lang]), [lang]).withColumnsRenamed({lang: "__l", "rate": "__r"} | {c: c + "2" for c in names})
    by_all = quantiles(merged(own, []), []).withColumnsRenamed({"rate": "__a"} | {c: c + "3" for c in names})
    q = q.join(by_lang, q[lang].eqNullSafe(F.col("__l")) & (q["rate"] == F.col("__r")), "left").join(F.broadcast(by_all), q["rate"] == F.col("__a"), "left")  # by_all: a row for each rate
    q = q.select(lang, source, "rate", *(F.expr(drawn(c, weight)).alias(c) for c in QUANTILES))
    out = []
    for rate, (k, least, lower) in RULES.items():
        here, width = F.col("rate") == rate, F.expr(f"greatest({k} * (mid - low), {k} * (high - mid), {least})")
        out.append(F.max(F.when(here, F.col("mid") + width)).alias(f"{rate}_most"))
        if lower:
            out.append(F.max(F.when(here, F.col("mid") - width)).alias(f"{rate}_least"))
    return q.groupBy(lang, source).agg(*out)


def drawn(c: str, weight: int) -> str:
    """A source's quantile drawn to its language's, that drawn to all documents'; whole numbers."""
    return f"(total * {c} + {weight} * ((total2 * {c}2 + {weight} * {c}3) div (total2 + {weight}))) div (total + {weight})"


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", weight: int = WEIGHT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row."""
    rows = materialize(counts(docs, id_col, text_col, F.col(lang_col).alias("g1"), F.col(source_col).alias("g2")), "counts")
    f = fences(rows, "g1", "g2", weight).withColumnsRenamed({"g1": "f1", "g2": "f2"})
    rows = rows.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
    inside = " and ".join(f"({e}) <= {k}_most" + (f" and ({e}) >= {k}_least" if RULES[k][2] else "") for k, e in rates().items())
    out = rows.join(f, rows["g1"].eqNullSafe(f["f1"]) & rows["g2"].eqNullSafe(f["f2"]), "left")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.expr(f"not base_failed and {inside}").alias("kept"))


def oracle_sql() -> str:
    """The same in DuckDB SQL over the view documents."""
    rate = {k: e.replace(" div ", " // ") for k, e in rates().items()}
    cut = "(value >> greatest(length(bin(value)) - 7, 0)) << greatest(length(bin(value)) - 7, 0)"
    unions = " union all ".join(f"select lang, source, '{k}' as rate, {e} as value from c" for k, e in rate.items())

    def quant(name: str, by: str) -> str:
        key = f"{by}, " if by else ""
        at = ", ".join(f"min(bucket) filter (upto * 100 >= total * {share}) as {c}" for c, share in QUANTILES.items())
        return f"""{name} as (select {key}rate, max(total) as total, {at} from (
            select {key}rate, bucket, sum(n) over (partition by {key}rate) as total, sum(n) over (partition by {key}rate order by bucket) as upto
            from (select {key}rate, bucket, sum(n) as n from s group by {key}rate, bucket)) group by {key}rate)"""

    most = []
    for k, (times, least, lower) in RULES.items():
        width = f"greatest({times} * (mid - low), {times} * (high - mid), {least})"
        most.append(f"max(case when rate = '{k}' then mid + {width} end) as {k}_most")
        if lower:
            most.append(f"max(case when rate = '{k}' then mid - {width} end) as {k}_least")
    own = ", ".join(
        f"((q1.total * q1.{c} + {WEIGHT} * ((q2.total * q2.{c} + {WEIGHT} * q3.{c}) // (q2.total + {WEIGHT}))) // (q1.total + {WEIGHT}))::bigint as {c}" for c in QUANTILES
    )
    inside = " and ".join(f"({e}) <= {k}_most" + (f" and ({e}) >= {k}_least" if RULES[k][2] else "") for k, e in rate.items())
    return rf"""
    with d as (select doc_id, lang, source, coalesce(text, '') as t from documents),
    w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
    u as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as a from w),
    p as (select doc_id, i, a, lead(a) over o as b, lead(a, 2) over o as e from u window o as (partition by doc_id order by i)),
    g as (select doc_id, i, count(*) over (partition by doc_id, a, b, e) as n from p where e is not null),
    r as (select doc_id, count(distinct k) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as k from g where n > 1) group by doc_id),
    c as (select w.doc_id, lang, source, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join r using (doc_id)),
    s as (select lang, source, rate, {cut} as bucket, count(*) as n from ({unions}) group by all),
    {quant("q1", "lang, source")}, {quant("q2", "lang")}, {quant("q3", "")},
    q as (select q1.lang, q1.source, q1.rate, {own}
        from q1 join q2 on q1.lang is not distinct from q2.lang and q1.rate = q2.rate join q3 on q1.rate = q3.rate),
    f as (select lang, source, {", ".join(most)} from q group by lang, source)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
        not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and {inside} as kept
    from c join f on c.lang is not distinct from f.lang and c.source is not distinct from f.source
    """
