"""Corpus operators: lines, sentences, tokens, counts, n-grams and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions.text import PLAIN_WORD

BOS, EOS = "<s>", "</s>"


def lines(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """Trimmed lines that are not empty, one row each."""
    return docs.select(*keep, F.explode(F.split(text, "\n")).alias("line")).withColumn("line", F.trim("line", F.lit(" \t\n\x0b\f\r"))).where("line != ''")


def distinct_lines(rows: DataFrame) -> DataFrame:
    """One row for each distinct line, by MD5: the shuffle carries partial results of each task's own duplicates."""
    return rows.groupBy(F.md5("line").alias("md5")).agg(F.min("line").alias("line"), F.count("*").alias("copies"))


def words(line: Column, pattern: str = PLAIN_WORD) -> Column:
    return F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda w: F.lower(w))


def tokens(rows: DataFrame, pattern: str = PLAIN_WORD, *keep: str) -> DataFrame:
    return rows.select(*keep, F.explode(words(F.col("line"), pattern)).alias("word"))


def token_counts(toks: DataFrame, least: int = 1) -> DataFrame:
    """(word, count): hot words meet in map-side partial sums."""
    out = toks.groupBy("word").agg(F.count("*").alias("count"))
    return out.where(F.col("count") >= least) if least > 1 else out


def corpus_stats(docs: DataFrame, text: str = "text", pattern: str = PLAIN_WORD) -> DataFrame:
    """One row: lines read and kept, duplication factor, tokens, types, hapaxes."""
    unique = distinct_lines(lines(docs, text))
    read = unique.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("lines_read"), F.count("*").alias("lines_kept"))
    types = token_counts(tokens(unique, pattern)).agg(F.coalesce(F.sum("count"), F.lit(0)).alias("tokens"), F.count("*").alias("types"), F.count_if(F.col("count") == 1).alias("hapax"))
    factor = F.when(F.col("lines_kept") > 0, F.bround(F.col("lines_read") / F.col("lines_kept"), 2)).otherwise(0.0)
    return read.crossJoin(F.broadcast(types)).withColumn("duplication_factor", factor)  # one row each


def sentences(unique: DataFrame, pattern: str = PLAIN_WORD) -> DataFrame:
    """(md5, position, tokens): sentences of distinct lines, split after . ! ?, those without a token dropped."""
    cut = unique.select("md5", F.posexplode(F.split("line", r"(?<=[.!?])\s+")).alias("position", "sentence"))
    return cut.select("md5", "position", words(F.col("sentence"), pattern).alias("tokens")).where(F.size("tokens") > 0)


def padded(tokens_: Column) -> Column:
    return F.concat(F.array(F.lit(BOS), F.lit(BOS)), tokens_, F.array(F.lit(EOS)))


def ngrams(sents: DataFrame, n: int, least: int = 1, part: tuple[int, int] | None = None) -> DataFrame:
    """(w1 .. wn, count) over the padded sentences, counts below least dropped. part (k, of): only the grams of the k-th of so many hashes."""
    p = sents.select(padded(F.col("tokens")).alias("p"))
    names = [f"w{k + 1}" for k in range(n)]
    runs = F.arrays_zip(*[F.slice("p", k + 1, F.size("p") - n + 1) for k in range(n)])
    grams = p.select(F.explode(runs).alias("g")).select(*[F.col("g").getField(str(k)).alias(x) for k, x in enumerate(names)])
    if part:
        grams = grams.where(F.pmod(F.xxhash64(*names), F.lit(part[1])) == part[0])
    out = grams.groupBy(*names).agg(F.count("*").alias("count"))
    return out.where(F.col("count") >= least) if least > 1 else out


def flat_grams(uni: DataFrame, bi: DataFrame, tri: DataFrame) -> DataFrame:
    """(gram, n, count): the three tables as one stream, grams joined by tabs."""
    one = lambda df, n: df.select(F.concat_ws("\t", *[f"w{k + 1}" for k in range(n)]).alias("gram"), F.lit(n).alias("n"), "count")
    return one(uni, 1).unionByName(one(bi, 2)).unionByName(one(tri, 3))


def ngram_info(flat: DataFrame) -> DataFrame:
    """(n, grams, occurrences): markers are not counted as unigrams."""
    plain = flat.where(~((F.col("n") == 1) & F.col("gram").isin(BOS, EOS)))
    return plain.groupBy("n").agg(F.count("*").alias("grams"), F.sum("count").alias("occurrences"))


def sample_sentences(sents: DataFrame, n: int, seed: int = 7, least: int = 8, most: int = 22) -> DataFrame:
    """n sentences of least to most tokens, those of the smallest seeded hash: the same on any cluster."""
    fit = sents.where(F.size("tokens").between(least, most)).dropDuplicates(["tokens"])
    return fit.orderBy(F.xxhash64(F.concat_ws(" ", "tokens"), F.lit(seed)), F.concat_ws(" ", "tokens")).limit(n)
