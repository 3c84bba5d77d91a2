"""Admission of corpus words to the suggestion pool: one cascade, the first failing test names the bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions import phonology
from morphlake.functions.text import fold_marks, restore_marks
from morphlake.profile import LanguageProfile

from . import fuzzy, lexicon as lex

# Least count, dominance ratio, letters of the script and banned ones.
FLOOR, RATIO, LATIN, BANNED = 20, 5, "abcdefghijklmnopqrstuvwxyzïñ'-", "fvzcxq"
TESTS = ("below_floor", "in_lexicon", "foreign_char", "banned_letter", "foreign_word", "quarantined", "folds_onto_headword", "phonotactic", "runtogether", "dominated", "restored_onto_headword", "admitted")


def decide(counts: DataFrame, lexicon: DataFrame, profile: LanguageProfile, foreign: DataFrame | None = None, quarantine: DataFrame | None = None, runtogether: DataFrame | None = None, confirmed: DataFrame | None = None, floor: int = FLOOR, ratio: int = RATIO, latin: str = LATIN, banned: str = BANNED) -> DataFrame:
    """(word, count, canon, reason). lexicon: entries; foreign, quarantine, confirmed: (word); runtogether: (surface).

    Only words at the floor meet the joins. confirmed: words whose closing tilde is attested; others keep the plain form.
    """
    spark = counts.sparkSession
    none = spark.createDataFrame([], "word string")
    forms = lex.surface_forms(lexicon)
    high = counts.where(F.col("count") >= floor).withColumn("w", F.lower("word"))
    out = lex.is_known(high, lexicon, "w")
    out = lex.member(out, forms, "__s", "w")
    out = lex.member(out, foreign if foreign is not None else none, "__f", "w")
    out = lex.member(out, quarantine.select(F.lower("word").alias("word")) if quarantine is not None else none, "__q", "w")
    out = lex.member(out.withColumn("__k", fold_marks(F.col("w"))), forms.select(fold_marks(F.col("word")).alias("word")), "__h", "__k")
    out = lex.member(out, runtogether.select(F.col("surface").alias("word")) if runtogether is not None else none, "__r", "w")
    out = out.join(fuzzy.dominant_neighbour(counts, ratio, high.select("word")).select("word", F.lit(True).alias("__d")), "word", "left")
    out = lex.member(out, confirmed if confirmed is not None else none, "__c", "w")
    canon = restore_marks(F.col("w"))
    plain = F.regexp_replace(canon, "aiñ$", "ain")
    out = out.withColumn("canon", F.when(canon.endswith("aiñ") & ~F.col("w").endswith("aiñ") & ~F.col("__c"), plain).otherwise(canon))
    out = lex.member(lex.member(out, forms, "__o", "canon"), lex.known_forms(lexicon), "__p", "canon")
    reason = (
        F.when(F.col("is_known") | F.col("__s"), "in_lexicon").when(F.translate("w", latin, "") != "", "foreign_char").when(F.translate("w", banned, "") != F.col("w"), "banned_letter")
        .when(F.col("__f"), "foreign_word").when(F.col("__q"), "quarantined").when(F.col("__h"), "folds_onto_headword").when(~phonology.is_valid(F.col("w"), profile), "phonotactic")
        .when(F.col("__r"), "runtogether").when(F.col("__d"), "dominated").when((F.col("canon") != F.col("w")) & (F.col("__o") | F.col("__p")), "restored_onto_headword").otherwise("admitted")
    )
    low = counts.where(F.col("count") < floor).select("word", "count", F.lower("word").alias("canon"), F.lit("below_floor").alias("reason"))
    return out.select("word", "count", "canon", reason.alias("reason")).unionByName(low)


def tally(decided: DataFrame) -> DataFrame:
    return decided.groupBy("reason").agg(F.count("*").alias("words"), F.sum("count").alias("occurrences"))


def admitted(decided: DataFrame) -> DataFrame:
    return decided.where("reason = 'admitted'").select(F.col("canon").alias("word")).distinct()


def accepted(decided: DataFrame) -> DataFrame:
    """Admitted forms and their folded spellings: what the check accepts."""
    a = admitted(decided)
    return a.union(a.select(fold_marks(F.col("word")))).distinct()
