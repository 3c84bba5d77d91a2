"""Symmetric-delete fuzzy joins, ranked suggestions, dominated types, split joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphlake.functions import edits, phonology
from morphlake.functions.text import first_letter_differs, phonemes, shared_prefix
from morphlake.profile import LanguageProfile
from morphlake.sources.store import written

# Distances and bonuses of the ranking.
NORMALISED, INVALID_SHAPE, CORPUS_FORM, PREFIX_BONUS = 0.5, 0.75, 0.3, 3


def delete_index(forms: DataFrame, k: int = 2, word: str = "word") -> DataFrame:
    """(deletion, word) of single words: the index side. Appending words is a union with their rows."""
    return forms.select(F.col(word).alias("word")).where("word != '' and not contains(word, ' ')").distinct().select(F.explode(edits.deletes(F.col("word"), k)).alias("deletion"), "word")


def candidates(queries: DataFrame, index: DataFrame, k: int = 2, word: str = "word") -> DataFrame:
    """(query, cand): pairs that share a deletion, themselves left out. An equi-join; common deletions can be split by AQE.

    The index is not broadcast: its estimate leaves out that a word has many deletions.
    """
    q = queries.select(F.lower(word).alias("query")).distinct().select("query", F.explode(edits.deletes(F.col("query"), k)).alias("deletion"))
    return q.join(index.withColumnRenamed("word", "cand").hint("merge"), "deletion").where("query != cand").select("query", "cand").distinct()


def near(pairs: DataFrame, profile: LanguageProfile, most: float) -> DataFrame:
    """pairs with distance (weighted, at most `most`); lengths further apart than the cap go before any Python runs."""
    return pairs.where(F.abs(F.length("query") - F.length("cand")) <= edits.CAP).withColumn("distance", edits.distance_udf(profile)(F.col("query"), F.col("cand"))).where(f"distance > 0 and distance <= {most}")


def ranked(queries: DataFrame, forms: DataFrame, freq: DataFrame, profile: LanguageProfile, top: int = 5, k: int = 2, most: float = 2.0, penalised: DataFrame | None = None, extra: DataFrame | None = None, offerable=None, word: str = "word") -> DataFrame:
    """(query, rank, cand, distance): by distance, first letter, frequency and shared units, then the word.

    Rewrites that are known stand at 0.5; candidates of an invalid shape pay 0.75, penalised ones 0.3. offerable filters
    before ranking. extra: more pairs (query, cand, distance), such as generated forms.
    """
    q = written(queries.select(F.lower(word).alias("query")).distinct(), "queries")
    pool = forms.select("word").distinct()
    if penalised is not None:
        pool = pool.union(penalised.select("word")).distinct()
    pool = written(pool, "pool")
    fixed = q.select("query", F.explode(edits.normalised(F.col("query"))).alias("cand")).join(pool.withColumnRenamed("word", "cand"), "cand", "left_semi").withColumn("distance", F.lit(NORMALISED)).withColumn("route", F.lit(0))
    found = written(near(candidates(q, delete_index(pool, k), k, "query"), profile, most), "near").withColumn("route", F.lit(1))
    found = found.withColumn("distance", F.col("distance") + F.when(phonology.is_valid(F.col("cand"), profile), 0.0).otherwise(INVALID_SHAPE))
    if penalised is not None:
        p = penalised.select(F.col("word").alias("cand")).distinct().withColumn("p", F.lit(CORPUS_FORM))
        found = found.join(p, "cand", "left").withColumn("distance", F.col("distance") + F.coalesce("p", F.lit(0.0))).drop("p")
    out = fixed.unionByName(found.where(f"distance <= {most}"))
    if extra is not None:
        out = out.unionByName(extra.select("query", "cand", "distance").withColumn("route", F.lit(2)))
    out = written(out.groupBy("query", "cand").agg(F.min_by("distance", "route").alias("distance")), "pairs")
    if offerable is not None:
        out = offerable(out)
    out = out.join(freq.select(F.col("word").alias("cand"), F.col("frequency").alias("f")), "cand", "left")
    units = lambda c: phonemes(F.col(c), profile.digraphs)
    score = F.coalesce("f", F.lit(0)) + PREFIX_BONUS * shared_prefix(units("query"), units("cand"))
    out = out.withColumns({"score": score, "first": first_letter_differs(F.col("query"), F.col("cand"))})
    w = Window.partitionBy("query").orderBy("distance", "first", F.desc("score"), "cand")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select("query", "rank", "cand", F.round("distance", 3).alias("distance"))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words are one deletion, swap, replacement or insertion apart, without Python."""
    la, lb = F.length(a), F.length(b)
    n = F.least(la, lb)
    head = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))))
    rest = lambda c, k: F.substr(c, head + 1 + k)
    swap = (F.substr(a, head + 1, F.lit(1)) == F.substr(b, head + 2, F.lit(1))) & (F.substr(a, head + 2, F.lit(1)) == F.substr(b, head + 1, F.lit(1))) & (rest(a, 2) == rest(b, 2))
    return (a != b) & F.when(la == lb, (rest(a, 1) == rest(b, 1)) | swap).when(la == lb + 1, rest(a, 1) == rest(b, 0)).when(lb == la + 1, rest(a, 0) == rest(b, 1)).otherwise(False)


def dominant_neighbour(counts: DataFrame, ratio: int = 5, targets: DataFrame | None = None, alphabet: str = "abcdefghijklmnopqrstuvwxyz") -> DataFrame:
    """(word, neighbour, neighbour_count): the most frequent type one edit away with at least ratio times the count.

    Ties: a deletion before a swap, a replacement, an insertion; then the word. Letters put in must be of the alphabet.
    """
    words = (targets.select("word").join(counts, "word") if targets is not None else counts).select("word", "count")
    # one-letter words meet by the empty string too
    d = lambda df: df.select("word", "count", F.explode(F.concat(edits.deletes(F.col("word"), 1), F.when(F.length("word") == 1, F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))).alias("deletion"))
    pairs = d(words).join(d(counts).withColumnsRenamed({"word": "neighbour", "count": "neighbour_count"}), "deletion").where(f"word != neighbour and neighbour_count >= count * {ratio}").select("word", "neighbour", "neighbour_count").distinct()
    pairs = pairs.where(one_edit(F.col("word"), F.col("neighbour")))
    la, lb = F.length("word"), F.length("neighbour")
    same_letters = F.array_sort(F.split("word", "")) == F.array_sort(F.split("neighbour", ""))
    kind = F.when(lb < la, 0).when((la == lb) & same_letters, 1).when(la == lb, 2).otherwise(3)
    new = F.array_join(F.array_except(F.split("neighbour", ""), F.split("word", "")), "")
    pairs = pairs.where(F.translate(new, alphabet, "") == "")
    return pairs.groupBy("word").agg(F.min(F.struct((-F.col("neighbour_count")).alias("c"), kind.alias("k"), "neighbour")).alias("m")).select("word", "m.neighbour", (-F.col("m.c")).alias("neighbour_count"))


def nearest_known(words: DataFrame, forms: DataFrame, profile: LanguageProfile, most: float = 1.0) -> DataFrame:
    """(query, nearest, distance)."""
    p = near(candidates(words, delete_index(forms, 1), 1), profile, most)
    return p.groupBy("query").agg(F.min(F.struct("distance", "cand")).alias("m")).select("query", F.col("m.cand").alias("nearest"), "m.distance")


def swapped_known(words: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, swapped): the first adjacent swap that is a known form."""
    n = F.greatest(F.length("word") - 1, F.lit(1))
    swap = lambda i: F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1, F.lit(1)), F.substr("word", i, F.lit(1)), F.substr("word", i + 2))
    made = words.select("word", F.posexplode(F.transform(F.sequence(F.lit(1), n), swap)).alias("at", "swapped")).where("swapped != word")
    return made.join(forms.select(F.col("word").alias("swapped")), "swapped", "left_semi").groupBy("word").agg(F.min_by("swapped", "at").alias("swapped"))


# ---------------------------------------------------------------- split joins


def splits(words: DataFrame, least: int = 1) -> DataFrame:
    """(word, at, left, right): every cut with parts of `least` letters or more."""
    w = words.select("word").distinct().where(F.length("word") >= 2 * least)
    return w.select("word", F.explode(F.sequence(F.lit(least), F.length("word") - least)).alias("at")).select("word", "at", F.substr("word", F.lit(1), F.col("at")).alias("left"), F.substr("word", F.col("at") + 1).alias("right"))


def _halves_known(cuts: DataFrame, forms: DataFrame) -> DataFrame:
    f = forms.select("word").distinct()
    return cuts.join(f.withColumnRenamed("word", "left"), "left", "left_semi").join(f.withColumnRenamed("word", "right"), "right", "left_semi")


def compound_splits(words: DataFrame, lexicon: DataFrame, profile: LanguageProfile, least: int = 3) -> DataFrame:
    """(word, left, right, both_open): the best cut into two entries spelled exactly, valid and not blocked.

    lexicon: (word, pos). Best: both open-class, then balance, then position.
    """
    blocked = [*profile.free_morphemes, *profile.clitics]
    cuts = splits(words, least).where(~F.col("left").isin([*blocked, *[p.form for p in profile.prefixes]]) & ~F.col("right").isin(blocked))
    pos = lexicon.groupBy("word").agg(F.min("pos").alias("pos"))
    out = cuts.join(pos.withColumnsRenamed({"word": "left", "pos": "pos1"}), "left").join(pos.withColumnsRenamed({"word": "right", "pos": "pos2"}), "right")
    out = out.where(phonology.is_valid(F.col("left"), profile) & phonology.is_valid(F.col("right"), profile))
    open_ = lambda c: F.lower(c).isin("noun", "verb", "adj", "adv", "adjective", "adverb")
    key = F.struct((~(open_("pos1") & open_("pos2"))).alias("closed"), F.abs(F.length("left") - F.length("right")).alias("balance"), "at", "left", "right", "pos1", "pos2")
    best = out.groupBy("word").agg(F.min(key).alias("m"))
    tag = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in {"n": "N", "v": "V", "a": "ADJ", "r": "ADV"}.items() for x in kv]), F.substr(F.lower(c), F.lit(1), F.lit(1))), F.lit("?"))
    return best.select("word", "m.left", "m.right", (~F.col("m.closed")).alias("both_open"), F.concat(tag("m.pos1"), F.lit("+"), tag("m.pos2")).alias("pattern"))


# Verdicts of the review table and the ratio that stands in for one.
SPLIT_VERDICTS = ("split", "yes", "y", "runtogether", "run-together", "1", "true")
KEEP_VERDICTS = ("keep", "no", "n", "solid", "word", "0", "false")
SPLIT_RATIO = 2.0


def runtogether(counts: DataFrame, bi: DataFrame, forms: DataFrame, least_count: int = 5, single: tuple[str, ...] = ("u", "i"), prior: DataFrame | None = None) -> DataFrame:
    """(surface, split_as, count, phrase_count, verdict): types that are two known words written as one, the first cut.

    prior: (surface, verdict) rulings; they stay, and ruled rows that are no longer found stay as well.
    """
    frequent = counts.where(F.col("count") >= least_count)
    ok = lambda c: (F.length(c) > 1) | F.col(c).isin(list(single))
    cuts = _halves_known(splits(frequent).where(ok("left") & ok("right")), forms)
    first = cuts.groupBy("word").agg(F.min(F.struct("at", "left", "right")).alias("m")).select("word", "m.left", "m.right")
    out = first.join(frequent, "word").join(bi.select(F.col("w1").alias("left"), F.col("w2").alias("right"), F.col("count").alias("phrase_count")), ["left", "right"], "left")
    out = out.select(F.col("word").alias("surface"), F.concat_ws(" ", "left", "right").alias("split_as"), "count", F.coalesce("phrase_count", F.lit(0)).cast("long").alias("phrase_count"))
    if prior is None:
        return out.withColumn("verdict", F.lit(""))
    p = prior.groupBy("surface").agg(F.max("verdict").alias("verdict"), F.max("split_as").alias("__s"))
    out = out.join(p, "surface", "full").where("split_as is not null or verdict != ''")
    return out.select("surface", F.coalesce("split_as", "__s").alias("split_as"), "count", "phrase_count", F.coalesce("verdict", F.lit("")).alias("verdict"))


def split_table(reviewed: DataFrame, ratio: float = SPLIT_RATIO) -> DataFrame:
    """(surface, split_as) to act on: ruled splits, and unruled ones whose phrase is ratio times as common."""
    v, low = F.lower(F.trim(F.coalesce("verdict", F.lit("")))), lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    solid, spaced = F.col("count").try_cast("long"), F.coalesce(F.col("phrase_count").try_cast("long"), F.lit(0))
    act = v.isin(*SPLIT_VERDICTS) | (~v.isin(*KEEP_VERDICTS) & (solid > 0) & (spaced >= solid * ratio))
    return reviewed.where(act & (low("surface") != "") & low("split_as").contains(" ")).select(low("surface").alias("surface"), low("split_as").alias("split_as"))


def function_word_splits(words: DataFrame, forms: DataFrame, function_words: DataFrame, bi: DataFrame, least: int = 5) -> DataFrame:
    """(word, left, right): the first cut into known halves, one a function word, whose bigram is common enough."""
    f = function_words.select("word").withColumn("fw", F.lit(True))
    out = _halves_known(splits(words), forms).join(f.withColumnsRenamed({"word": "left", "fw": "f1"}), "left", "left").join(f.withColumnsRenamed({"word": "right", "fw": "f2"}), "right", "left").where("f1 or f2")
    out = out.join(bi.where(F.col("count") >= least).select(F.col("w1").alias("left"), F.col("w2").alias("right")), ["left", "right"], "left_semi")
    return out.groupBy("word").agg(F.min(F.struct("at", "left", "right")).alias("m")).select("word", "m.left", "m.right")
