"""Lexicon repair: ordered rules (the first that fits decides), outcomes by what a repaired form meets, quarantine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.functions import text
from morphlake.functions.phonology import validate
from morphlake.profile import LanguageProfile

from .lexicon import same_meaning

Rule = tuple[str, Callable[[Column], Column]]
# The standard rules in their order; a rule fits where it changes the surface.
RULES: list[Rule] = [
    ("white_space", lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))), ("trailing_hyphen", lambda c: F.regexp_replace(c, "-+$", "")), ("brackets", text.without_brackets),
    ("double_i", text.double_i), ("opening_ia", text.opening_ia), ("closing_tilde", lambda c: F.regexp_replace(c, "ain$", "aiñ")), ("umlaut", lambda c: F.translate(c, "äëöü", "aeou")),
    ("apostrophes", lambda c: F.translate(c, "’ʼ`", "'''")), ("half_reduplication", lambda c: F.regexp_replace(c, r"^(\p{L}+)- \1$", "$1-$1")), ("marks", lambda c: F.regexp_replace(c, r"[\^~«»•|{}\\]", "")),
]


def first_rule(lexicon: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """lexicon with rule and repaired of the first rule that changes the surface (null where none does)."""
    rule, made = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, f in reversed(rules):
        new = f(F.col("surface"))
        fits = (new != F.col("surface")) & (new != "")
        rule, made = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, new).otherwise(made)
    return lexicon.withColumns({"rule": rule, "repaired": made})


def outcomes(lexicon: DataFrame, rules: list[Rule] = RULES, profile: LanguageProfile | None = None) -> DataFrame:
    """lexicon with rule, repaired and outcome: keep, duplicate (an entry of the repaired form means the same), conflict, rewrite, or quarantine (an invalid shape)."""
    r = first_rule(lexicon, rules)
    other = lexicon.select(F.lower("surface").alias("__s"), F.col("gloss").alias("__g"), F.col("entry_id").alias("__id"))
    met = r.where("rule is not null").join(other, (F.lower("repaired") == F.col("__s")) & (F.col("entry_id") != F.col("__id"))).groupBy("entry_id").agg(F.bool_or(same_meaning(F.col("gloss"), F.col("__g"))).alias("__same"))
    r = r.join(met, "entry_id", "left")
    bad = ~F.forall(F.split(F.lower(F.coalesce("repaired", "surface")), r"\s+"), lambda w: validate(w, profile)["valid"]) if profile else F.lit(False)
    outcome = F.when(F.col("__same"), "duplicate").when(F.col("__same").isNotNull(), "conflict").when(bad, "quarantine").when(F.col("rule").isNotNull(), "rewrite").otherwise("keep")
    return r.withColumn("outcome", outcome).drop("__same")


def apply(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lexicon after the repair, quarantined rows with their reason)."""
    base = [c for c in decided.columns if c not in ("rule", "repaired", "outcome")]
    kept = decided.where("outcome not in ('duplicate', 'quarantine')").withColumn("surface", F.when(F.col("outcome") == "rewrite", F.col("repaired")).otherwise(F.col("surface")))
    return kept.select(*base), decided.where("outcome = 'quarantine'").select(*base, F.coalesce("rule", F.lit("shape")).alias("reason"))


def retarget(lexicon: DataFrame, renamed: DataFrame, column: str = "related") -> DataFrame:
    """lexicon with references (array column) to renamed entries (old, new) rewritten."""
    m = renamed.select(F.lower("old").alias("__o"), "new")
    each = lexicon.select("entry_id", F.posexplode(column).alias("i", "x")).join(m, F.lower("x") == F.col("__o"), "left")
    new = each.groupBy("entry_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.coalesce("new", "x").alias("x")))), lambda s: s["x"]).alias("__n"))
    return lexicon.join(new, "entry_id", "left").withColumn(column, F.coalesce("__n", column)).drop("__n")


def quarantine(lexicon: DataFrame, rulings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) by a table of rulings (surface, reason)."""
    r = rulings.select(F.lower("surface").alias("__s"), "reason").dropDuplicates(["__s"])
    key = F.lower("surface") == F.col("__s")
    return lexicon.join(r, key, "left_anti"), lexicon.join(r, key).drop("__s")


def needs_cleaning(gloss: Column) -> Column:
    """Scan debris in a gloss: odd symbols, glued digits, an unclosed bracket."""
    return gloss.rlike(r"[\^~«»•|{}\\]|\p{L}\d|\([^)]*$|\[[^\]]*$|\s{2,}|^\s|\s$")


def clean_gloss(gloss: Column) -> Column:
    """struct(text, tail): the gloss without debris; tail is what an unclosed bracket cut off."""
    tail = F.regexp_extract(gloss, r"[(\[][^)\]]*$", 0)
    t = F.regexp_replace(F.regexp_replace(gloss, r"[(\[][^)\]]*$", ""), r"[\^~«»•|{}\\]", " ")
    return F.struct(F.trim(F.regexp_replace(F.regexp_replace(t, r"(\p{L})\d+\b", "$1"), r"\s+", " ")).alias("text"), tail.alias("tail"))


def merge_pieces(glosses: Column) -> Column:
    """Comma-split pieces rejoined: one that opens in lower case after a piece with an open bracket belongs to it."""
    opened = lambda s: F.length(F.regexp_replace(s, r"[^(]", "")) > F.length(F.regexp_replace(s, r"[^)]", ""))
    start = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a, -1)
        return F.when(F.size(a) == 0, F.array(x)).when(opened(last), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.concat(last, F.lit(", "), x)))).otherwise(F.concat(a, F.array(x)))

    return F.aggregate(glosses, start, step)
