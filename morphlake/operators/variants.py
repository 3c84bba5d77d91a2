"""Spelling variants: routes united, the first source of a variant wins, standard spellings first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.text import fold_key, fold_marks
from morphlake.profile import LanguageProfile

from . import lexicon as lex

# Order of the sources in the result; most marks put on a word.
ORDER = {"lexicon": 0, "gloss": 1, "root": 2, "rule": 3, "corpus": 4}
MAX_MARKS = 2
MARKS = {"i": "ï", "n": "ñ"}


def marked(c: Column, most: int = MAX_MARKS) -> Column:
    """All spellings with up to `most` marks added."""
    table = F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])
    out = F.array(c)
    for _ in range(most):
        put = lambda w: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.element_at(table, F.substr(w, i, F.lit(1))), F.substr(w, i + 1))), lambda x: x.isNotNull())
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, put))))
    return F.array_except(out, F.array(c))


def ia_forms(words: DataFrame, known: DataFrame, profile: LanguageProfile) -> DataFrame:
    """(word, variant): ia after a chain of up to three prefixes as ïa, where the rest is known with it."""
    p = F.broadcast(profile.prefix_rows(words.sparkSession).select("prefix"))
    step = words.select("word", F.lit("").alias("head"), F.col("word").alias("rest"))
    out = step
    for _ in range(3):
        step = step.join(p, F.col("rest").startswith(F.col("prefix")) & (F.length("rest") > F.length("prefix") + 1)).select("word", F.concat("head", "prefix").alias("head"), F.substr(F.col("rest"), F.length("prefix") + 1).alias("rest"))
        out = out.unionByName(step)
    made = out.where("startswith(rest, 'ia') and length(rest) > 3").withColumn("base", F.concat(F.lit("ï"), F.substr("rest", F.lit(2))))
    return made.join(known.select(F.col("word").alias("base")), "base", "left_semi").select("word", F.concat("head", "base").alias("variant")).distinct()


def tilde_forms(words: DataFrame, known: DataFrame) -> DataFrame:
    """(word, variant): a closing ain as aiñ, where the last part of three letters or more is known so and the head is a word or empty."""
    w = words.where("endswith(word, 'ain')").select("word")
    full = F.regexp_replace("word", "ain$", "aiñ")
    cuts = w.select("word", full.alias("full"), F.explode(F.sequence(F.lit(0), F.length("word") - 3)).alias("at")).select("word", "full", F.substr("full", F.lit(1), F.col("at")).alias("head"), F.substr("full", F.col("at") + 1).alias("tail"))
    hit = cuts.join(known.select(F.col("word").alias("tail")), "tail", "left_semi")
    whole = hit.where("head = ''").select("word", "full")
    part = hit.where("length(head) >= 3").join(known.select(F.col("word").alias("head")), "head", "left_semi").select("word", "full")
    return whole.union(part).distinct().withColumnRenamed("full", "variant")


def elided(full: Column, short: Column) -> Column:
    return short.contains("'") & ~full.contains("'")


def find(words: DataFrame, lexicon: DataFrame, profile: LanguageProfile, links: DataFrame | None = None, corpus_forms: DataFrame | None = None, affixed: DataFrame | None = None) -> DataFrame:
    """(word, variant, source, canonical, rank). links: (word, variant) from glosses; corpus_forms, affixed: (word)."""
    w = words.select(F.lower("word").alias("word")).distinct().where(F.length("word").between(1, 50))
    surf = lexicon.select(F.lower("surface").alias("word")).where("word != ''").distinct()
    known = lex.known_forms(lexicon)
    simple = w if affixed is None else w.join(affixed.select("word"), "word", "left_anti")
    folded = surf.select(F.col("word").alias("variant"), fold_key(F.col("word")).alias("k"))
    routes = [("lexicon", simple.withColumn("k", fold_key(F.col("word"))).join(folded, "k").where((F.col("word") != F.col("variant")) & (fold_marks(F.col("variant")) == F.col("word"))).select("word", "variant"))]
    routes.append(("lexicon", simple.select("word", F.explode(marked(F.col("word"))).alias("variant")).join(surf.withColumnRenamed("word", "variant"), "variant", "left_semi").select("word", "variant")))
    p = F.broadcast(profile.prefix_rows(w.sparkSession).select("prefix"))
    stem = w.join(p, F.col("word").startswith(F.col("prefix")) & (F.length("word") > F.length("prefix") + 1)).select("word", "prefix", F.substr(F.col("word"), F.length("prefix") + 1).alias("root"))
    roots = stem.select("word", "prefix", F.explode(marked(F.col("root"))).alias("marked")).join(surf.withColumnRenamed("word", "marked"), "marked", "left_semi")
    routes.append(("root", roots.select("word", F.concat("prefix", "marked").alias("variant"))))
    routes.append(("rule", ia_forms(w, known, profile)))
    routes.append(("rule", tilde_forms(w, known)))
    if links is not None:
        routes.append(("gloss", w.join(links.select("word", "variant"), "word").where(~elided(F.col("word"), F.col("variant")))))
    if corpus_forms is not None:
        plain = corpus_forms.select(F.col("word").alias("variant"), fold_marks(F.col("word")).alias("k"))
        routes.append(("corpus", w.join(plain, F.col("word") == F.col("k")).select("word", "variant")))
    found = None
    for i, (source, df) in enumerate(routes):
        row = df.where("word != variant").select("word", "variant", F.lit(i).alias("route"), F.lit(source).alias("source"))
        found = row if found is None else found.unionByName(row)
    best = found.groupBy("word", "variant").agg(F.min_by("source", "route").alias("source"))
    best = lex.member(best, surf, "canonical", "variant")
    order = F.element_at(F.create_map(*[F.lit(x) for kv in ORDER.items() for x in kv]), F.col("source"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy(F.desc("canonical"), order, "variant")))


def links_from_glosses(lexicon: DataFrame, pattern: str = r"\b(?:same as|see|var(?:iant)? of)\s+([\p{L}'\-]+)") -> DataFrame:
    """(word, variant): references in glosses to other headwords, both ways."""
    g = lexicon.select(F.lower("surface").alias("word"), F.explode(F.regexp_extract_all(F.lower(F.array_join("gloss", " ")), F.lit(pattern), F.lit(1))).alias("variant"))
    g = g.join(lexicon.select(F.lower("surface").alias("variant")).distinct(), "variant", "left_semi").where("word != variant").select("word", "variant")
    return g.union(g.select(F.col("variant"), F.col("word"))).distinct()
