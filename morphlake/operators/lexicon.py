"""The lexicon: lookups, membership, upserts, statistics. A lexicon is a table (entry_id, surface, root, pos, gloss, confidence, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions.text import canonical, fold_key

from .frequency import compound_weight


def flatten(nested: DataFrame) -> DataFrame:
    """Nested entries (form, lemma, grammar, semantics, validation) as flat rows; nulls become empty, confidence 1.0."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return nested.select(
        "entry_id", text("form.surface").alias("surface"), text("lemma.root").alias("root"), text("grammar.pos").alias("pos"), text("grammar.clitic").alias("clitic"),
        F.coalesce("semantics.gloss", F.array().cast("array<string>")).alias("gloss"), F.coalesce("validation.confidence", F.lit(1.0)).cast("decimal(4,3)").alias("confidence"), F.coalesce("validation.needs_review", F.lit(False)).alias("needs_review"),
    )


def nest(flat: DataFrame) -> DataFrame:
    """The inverse of flatten."""
    return flat.select(
        "entry_id", F.struct("surface", F.lower("surface").alias("normalized")).alias("form"), F.struct("root").alias("lemma"), F.struct("pos", "clitic").alias("grammar"),
        F.struct("gloss").alias("semantics"), F.struct("confidence", "needs_review").alias("validation"),
    )


def patch(base: DataFrame, changes: DataFrame, key: str = "entry_id", clear: str = "") -> DataFrame:
    """base with changed fields: null keeps, `clear` empties, any other value sets. Columns that changes lack keep."""
    c = changes.select(key, *[F.col(x).alias("__" + x) for x in changes.columns if x != key])
    out = base.join(c, key, "left")
    return out.select(key, *[(F.when(F.col("__" + x) == clear, F.lit(None).cast(base.schema[x].dataType)).otherwise(F.coalesce("__" + x, x)) if "__" + x in c.columns else F.col(x)).alias(x) for x in base.columns if x != key])


def keys(lexicon: DataFrame) -> DataFrame:
    """lexicon with surface_key, root_key and fold columns for the three lookups."""
    return lexicon.withColumns({"surface_key": F.lower("surface"), "root_key": F.lower("root"), "fold": fold_key(F.col("surface"))})


def lookup(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """words with entry_id and matched_on (surface, root, fold or null): the first kind of match decides; ties by length difference, surface, id."""
    k = keys(lexicon)
    asked = words.select(F.col(word).alias("__w")).distinct().withColumns({"__l": F.lower("__w"), "__f": fold_key(F.col("__w"))})
    arms = [asked.join(k, F.col(a) == F.col(b)).withColumns({"__k": F.lit(i), "matched_on": F.lit(name)}) for i, (a, b, name) in enumerate((("__l", "surface_key", "surface"), ("__l", "root_key", "root"), ("__f", "fold", "fold")))]
    found = arms[0].unionByName(arms[1]).unionByName(arms[2])
    best = found.groupBy("__w").agg(F.min(F.struct("__k", F.abs(F.length("surface") - F.length("__w")).alias("d"), "surface", "entry_id", "matched_on")).alias("m"))
    return words.join(best.select("__w", "m.entry_id", "m.matched_on"), F.col(word) == F.col("__w"), "left").drop("__w")


def phrase_tokens(lexicon: DataFrame) -> DataFrame:
    """(token, host, entry_id): the words of surfaces with more than one."""
    return lexicon.where(F.size(F.split(F.trim("surface"), r"\s+")) > 1).select(F.explode(F.split(F.lower(F.trim("surface")), r"\s+")).alias("token"), F.lower("surface").alias("host"), "entry_id")


def compound_hosts(lexicon: DataFrame) -> DataFrame:
    """(token, hosts array, n)."""
    return phrase_tokens(lexicon).groupBy("token").agg(F.array_sort(F.collect_set("host")).alias("hosts"), F.countDistinct("host").alias("n"))


def known_forms(lexicon: DataFrame, screen=None) -> DataFrame:
    """(word): surfaces and the words of phrases; screen(column) keeps only well-formed phrase words."""
    t = phrase_tokens(lexicon).select(F.col("token").alias("word"))
    if screen is not None:
        t = t.where(screen(F.col("word")))
    return lexicon.select(F.lower("surface").alias("word")).union(t).where("word != ''").distinct()


def attested_forms(lexicon: DataFrame) -> DataFrame:
    """(word): surfaces, all words of phrases, roots; no folding."""
    return known_forms(lexicon).union(lexicon.select(F.lower("root")).where("root != ''")).distinct()


def surface_forms(lexicon: DataFrame, foreign: DataFrame | None = None) -> DataFrame:
    """(word): single-word surfaces, roots and phrase words, without foreign phrase words that are neither headword nor root."""
    own = lexicon.select(F.lower("surface").alias("word")).union(lexicon.select(F.lower("root"))).where("word != ''").distinct()
    t = phrase_tokens(lexicon).select(F.col("token").alias("word")).distinct().join(own, "word", "left_anti")
    if foreign is not None:
        t = t.join(foreign.select("word"), "word", "left_anti")
    return own.union(t).where("not contains(word, ' ')").distinct()


def is_known(words: DataFrame, lexicon: DataFrame, word: str = "word", screen=None) -> DataFrame:
    """words with is_known: surface, phrase word that screen(column) passes, or folded match; words are canonicalised first."""
    exact = known_forms(lexicon, screen).select(F.col("word").alias("__x")).withColumn("__e", F.lit(True))
    fold = lexicon.select(fold_key(F.col("surface")).alias("__fk")).distinct().withColumn("__f", F.lit(True))
    own = F.lower(canonical(F.col(word)))
    out = words.withColumns({"__w": own, "__k": fold_key(own)}).join(exact, F.col("__w") == F.col("__x"), "left").join(fold, F.col("__k") == F.col("__fk"), "left")
    return out.withColumn("is_known", F.coalesce("__e", "__f", F.lit(False))).drop("__w", "__k", "__x", "__e", "__fk", "__f")


def member(words: DataFrame, forms: DataFrame, flag: str, word: str = "word") -> DataFrame:
    """words with flag: whether the word stands in forms (word)."""
    f = forms.select(F.col("word").alias("__m")).distinct().withColumn(flag, F.lit(True))
    return words.join(f, F.col(word) == F.col("__m"), "left").drop("__m").withColumn(flag, F.coalesce(flag, F.lit(False)))


def pseudo_frequency(lexicon: DataFrame) -> DataFrame:
    """(word, pseudo): roots 20, surfaces 12 (15 where they are their root, 5 more with an affix), phrase words 8 to 19; the largest counts."""
    s = lexicon.select(F.lower("surface").alias("word"), (F.when(F.lower("surface") == F.lower("root"), 15).otherwise(12) + F.when((F.coalesce("root", F.lit("")) != "") & (F.lower("surface") != F.lower("root")) & F.lower("surface").contains(F.lower("root")), 5).otherwise(0)).cast("long").alias("v"))
    r = lexicon.where("root != ''").select(F.lower("root").alias("word"), F.lit(20).cast("long").alias("v"))
    t = phrase_tokens(lexicon).groupBy(F.col("token").alias("word")).agg(compound_weight(F.count("*")).alias("v"))
    return s.union(r).union(t).where("word != ''").groupBy("word").agg(F.max("v").alias("pseudo"))


def stats(lexicon: DataFrame) -> DataFrame:
    """One row of totals."""
    return lexicon.agg(
        F.count("*").alias("entries"), F.countDistinct(F.lower("surface")).alias("surfaces"), F.countDistinct(F.when(F.col("root") != "", F.lower("root"))).alias("roots"),
        F.count_if(F.col("needs_review")).alias("needs_review"), F.count_if(F.contains("surface", F.lit(" "))).alias("phrases"), F.count_if(F.lower("surface") == F.lower("root")).alias("bare"), F.countDistinct("pos").alias("classes"),
    )


# ---------------------------------------------------------------- changes


def upsert(target: DataFrame, source: DataFrame, key: str = "entry_id", prune: bool = False) -> DataFrame:
    """target with source's rows by key: replaced or added; prune drops what source lacks. One full outer join."""
    s = source.select(F.col(key).alias("__key"), F.struct(*target.columns).alias("__row"))
    out = target.withColumn("__old", F.struct(*target.columns)).select(key, "__old").join(s, F.col(key) == F.col("__key"), "full")
    if prune:
        out = out.where("__key is not null")
    return out.select(F.coalesce("__row", "__old").alias("r")).select("r.*")


def orphans(target: DataFrame, source: DataFrame, key: str = "entry_id") -> DataFrame:
    return target.join(source.select(key), key, "left_anti")


def delete(target: DataFrame, ids: DataFrame, key: str = "entry_id") -> DataFrame:
    return target.join(ids.select(key).distinct(), key, "left_anti")


def next_entry_id(lexicon: DataFrame) -> DataFrame:
    """One row (next_id): the most common prefix's largest number plus one, padded to the prefix's widest number."""
    parts = lexicon.select(F.regexp_extract("entry_id", r"^(.*?)(\d+)$", 1).alias("p"), F.regexp_extract("entry_id", r"^(.*?)(\d+)$", 2).alias("d")).where("d != ''")
    by = parts.groupBy("p").agg(F.count("*").alias("n"), F.max(F.col("d").cast("long")).alias("top"), F.max(F.length("d")).alias("w"))
    return by.agg(F.max(F.struct("n", "p", "top", "w")).alias("m")).select(F.concat("m.p", F.lpad((F.col("m.top") + 1).cast("string"), F.greatest("m.w", F.length((F.col("m.top") + 1).cast("string"))), "0")).alias("next_id"))


def merge_same_surface(lexicon: DataFrame) -> DataFrame:
    """One entry for each surface: the smallest id stays, glosses are joined in id order without repeats."""
    g = lexicon.groupBy(F.lower("surface").alias("__s")).agg(F.min_by(F.struct(*lexicon.columns), "entry_id").alias("r"), F.array_sort(F.collect_list(F.struct("entry_id", "gloss"))).alias("g"))
    return g.select("r.*", "g").withColumn("gloss", F.array_distinct(F.flatten(F.col("g.gloss")))).drop("g")


def same_meaning(a: Column, b: Column) -> Column:
    """Two glosses (arrays) mean the same: equal lines, or one within the other."""
    x, y = F.lower(F.array_join(a, " ")), F.lower(F.array_join(b, " "))
    return (x != "") & (y != "") & ((x == y) | x.contains(y) | y.contains(x))


def glosses(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """words with gloss: the matched entry's gloss line, empty without one."""
    g = lexicon.select("entry_id", F.array_join("gloss", " ").alias("__g"))
    return lookup(words, lexicon, word).join(g, "entry_id", "left").withColumn("gloss", F.coalesce("__g", F.lit(""))).drop("__g", "entry_id", "matched_on")


def stitched_phonology(lexicon: DataFrame) -> DataFrame:
    """(entry_id, syllables): for phrases, each word's own syllables in order; a word without an entry stands for itself."""
    own = lexicon.where("not contains(surface, ' ')").groupBy(F.lower("surface").alias("token")).agg(F.min_by("syllables", "entry_id").alias("s"))
    t = lexicon.where("contains(surface, ' ')").select("entry_id", F.posexplode(F.split(F.lower("surface"), r"\s+")).alias("i", "token"))
    out = t.join(own, "token", "left").groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("s", F.array("token")).alias("s")))).alias("x"))
    return out.select("entry_id", F.flatten(F.col("x.s")).alias("syllables"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("__n = 1").drop("__n")


def by_id(ids: DataFrame, lexicon: DataFrame, key: str = "entry_id") -> DataFrame:
    """The entries of the asked ids; ids without an entry give no row."""
    return lexicon.join(ids.select(key).distinct(), key, "left_semi").select(*lexicon.columns)


def enriched(ids: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The asked entries in their nested shape."""
    return nest(by_id(ids, lexicon))


def vocabulary_size(forms: DataFrame) -> DataFrame:
    """One row (words): how many distinct forms may be offered."""
    return forms.agg(F.countDistinct("word").alias("words"))


def word_forms(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """(word, forms array): all surfaces that share the word's root, sorted; words without an entry are left out."""
    own = lexicon.where("root != ''").select(F.lower("surface").alias("form"), F.lower("root").alias("__root")).distinct()
    asked = words.select(F.lower(word).alias("word")).distinct()
    roots = asked.join(own.withColumnRenamed("form", "word"), "word").select("word", "__root").union(asked.join(own.select("__root").distinct(), F.col("word") == F.col("__root")).select("word", "__root")).distinct()
    return roots.join(own, "__root").groupBy("word").agg(F.array_sort(F.collect_set("form")).alias("forms"))
