"""Readers and writers: text corpora, JSON and CSV tables, JDBC, n-gram stores. Missing optional tables read as empty."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COUNTS = "word string, count long"
GRAMS = "gram string, n int, count long"


def optional(spark: SparkSession, schema: str, read) -> DataFrame:
    """What read() gives, or an empty table where its path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], schema)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): the lines of all text files below path; malformed bytes become replacement characters."""
    return spark.read.option("recursiveFileLookup", "true").text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """(word, count) from a JSON object of counts, {"counts": {...}} or bare; gzip by its suffix."""
    raw = spark.read.option("multiLine", "true").option("wholetext", "true").text(path)
    whole = raw.select(F.try_variant_get(F.parse_json("value"), "$.counts", "map<string,bigint>").alias("m"), F.try_variant_get(F.parse_json("value"), "$", "map<string,bigint>").alias("b"))
    out = whole.select(F.explode(F.coalesce("m", "b")).alias("word", "count"))
    return out


def word_list(spark: SparkSession, path: str, field: str = "tokens") -> DataFrame:
    """(word) from a JSON object's `field`: the names of an object ({word: list or count}), or an array of words.

    Empty where the file is missing; an error where the field is neither.
    """
    at = lambda kind: F.try_variant_get(F.parse_json("value"), f"$.{field}", kind)
    named = F.coalesce(F.map_keys(at("map<string,variant>")), at("array<string>"))
    found = F.coalesce(named, F.raise_error(F.lit(f"no words under {field} in {path}")).cast("array<string>"))
    return optional(spark, "word string", lambda: spark.read.option("wholetext", "true").text(path).select(F.explode(found).alias("word")))


def spelling_links(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant) from {"links": {word: [spelling, ...]}}; empty where the file is missing."""
    raw = lambda: spark.read.option("wholetext", "true").text(path).select(F.explode(F.try_variant_get(F.parse_json("value"), "$.links", "map<string,array<string>>")).alias("word", "v")).select("word", F.explode("v").alias("variant"))
    return optional(spark, "word string, variant string", raw)


def reviewed_splits(spark: SparkSession, path: str) -> DataFrame:
    """(surface, split_as, count, phrase_count, verdict) from the review CSV; empty where it is missing."""
    schema = "surface string, split_as string, count string, phrase_count string, verdict string"
    raw = lambda: spark.read.option("header", "true").option("escape", '"').csv(path)
    out = optional(spark, schema, raw)
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None).cast("string")).alias(c) for c in ("surface", "split_as", "count", "phrase_count", "verdict")])


def word_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(wrong_word, correct_word) from a CSV."""
    return spark.read.option("header", "true").csv(path).select("wrong_word", "correct_word")


def lexicon_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Nested entries from JSON lines, with a stated schema."""
    return spark.read.schema(schema).json(path)


def save_lexicon(lexicon: DataFrame, path: str, how: str = "parquet") -> None:
    lexicon.write.mode("overwrite").format(how).save(path)


def save_grams(flat: DataFrame, path: str) -> None:
    """The n-gram store: Parquet by order n, so a reader of one order prunes the others; an order is written by many tasks."""
    flat.repartition("n", "gram").write.mode("overwrite").partitionBy("n").parquet(path)


def load_grams(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """uni, bi and tri from an n-gram store."""
    flat = spark.read.parquet(path)
    parts = F.split("gram", "\t")
    return {name: flat.where(F.col("n") == n).select(*[F.get(parts, F.lit(k)).alias(f"w{k + 1}") for k in range(n)], "count") for name, n in (("uni", 1), ("bi", 2), ("tri", 3))}


def upsert_grams(old: DataFrame, new: DataFrame, prune: bool = False) -> DataFrame:
    """The store after new counts: replaced or added; prune drops grams that the new model lacks."""
    j = old.withColumnRenamed("count", "o").join(new.withColumnRenamed("count", "c"), ["gram", "n"], "full")
    return (j.where("c is not null") if prune else j).select("gram", "n", F.coalesce("c", "o").alias("count"))


def jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, parts: int = 16, low: int = 0, high: int = 1 << 31, **options: str) -> DataFrame:
    """A JDBC table, read in ranges of a numeric key where one is named."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if key:
        r = r.options(partitionColumn=key, numPartitions=str(parts), lowerBound=str(low), upperBound=str(high))
    return r.load()


def first_available(spark: SparkSession, *reads) -> DataFrame | None:
    """The first reader that has rows (a populated store before a file), or None."""
    for read in reads:
        try:
            df = read()
            if not df.isEmpty():
                return df
        except AnalysisException:
            continue
    return None


def with_columns(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """df with the optional columns that it lacks, as nulls of a type."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in defaults.items() if c not in df.columns}) if set(defaults) - set(df.columns) else df


def settings(path: str) -> dict[str, str]:
    """KEY=value lines of a file where the environment has no such name; the environment wins. Missing file: none."""
    out: dict[str, str] = {}
    if os.path.isfile(path):
        with open(path, encoding="utf-8") as f:
            for line in map(str.strip, f):
                name, eq, value = line.removeprefix("export ").partition("=")
                if eq and name.strip() and not line.startswith("#"):
                    out[name.strip()] = os.environ.get(name.strip(), value.strip().strip("\"'"))
    return out


def report(flags: DataFrame, docs: DataFrame, key: str, path: str, text: str = "text") -> None:
    """`key:line:column token -> suggestion` lines as text files."""
    from morphlake.operators.tokens import line_column

    j = flags.join(docs.select(key, F.col(text).alias("__t")), key).withColumn("__p", line_column(F.col("__t"), F.col("start")))
    j.select(F.concat_ws(":", F.col(key).cast("string"), "__p.line", F.concat_ws(" ", F.col("__p.col").cast("string"), "tok", F.lit("->"), F.coalesce(F.get("suggestions", F.lit(0))["cand"], F.lit("?"))))).write.mode("overwrite").text(path)
