"""String scalars as columns. Everything but NFC is a built-in expression and stays in the JVM."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.profile import LanguageProfile

# Character classes and maps of the token rules.
APOSTROPHES = "’ʼ"
INVISIBLES = "­​‌‍⁠﻿"
NOISE = "^~«»•|\\{}[]"
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿＡ-Ｚａ-ｚ"
LOOKALIKES = "аеорсухіјѕԁһӏАВЕКМНОРСТХІЈЅοαιρυνκΟΑΒΕΗΙΚΜΝΡΤΥΧΖ"
LATIN = "aeopcyxijsdhlABEKMHOPCTXIJSoaipuvkOABEHIKMNPTYXZ"
PLAIN_WORD = r"[A-Za-zÏïÑñ]+(?:['\-][A-Za-zÏïÑñ]+)*"  # the corpus builders' token
ACCENTED, UNACCENTED = "ïñáéíóúýÏÑÁÉÍÓÚÝ", "inaeiouyINAEIOUY"


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    """NFC; null becomes empty."""
    return s.fillna("").map(lambda x: x if x.isascii() else unicodedata.normalize("NFC", x))


def canonical(c: Column, normalised: bool = False) -> Column:
    """NFC, typewriter apostrophes, ASCII for full-width letters, no invisible characters. normalised: c is NFC already."""
    wide = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
    narrow = "".join(chr(ord(x) - 0xFEE0) for x in wide)
    return F.translate(F.coalesce(c, F.lit("")) if normalised else nfc(c), APOSTROPHES + wide + INVISIBLES, "''" + narrow)


def latinise(c: Column) -> Column:
    """Cyrillic and Greek look-alikes as the Latin letters that they look like."""
    return F.translate(F.coalesce(c, F.lit("")), LOOKALIKES, LATIN)


def unaccented(c: Column) -> Column:
    return F.translate(c, ACCENTED, UNACCENTED)


def corpus_form(c: Column, normalised: bool = False) -> Column:
    """The spelling that corpus counts use: canonical without accents and apostrophes, case kept."""
    return F.translate(unaccented(canonical(c, normalised)), "'", "")


def fold_key(c: Column, normalised: bool = False) -> Column:
    """The lexicon's folded key: canonical, lower, without accents and apostrophes."""
    return F.translate(unaccented(F.lower(canonical(c, normalised))), "'", "")


def fold_marks(c: Column) -> Column:
    """Only the two diacritic letters folded: the pool's comparison key."""
    return F.translate(c, "ïñ", "in")


def restore_marks(c: Column, before: tuple[str, ...] = ("jing", "pyn", "nong")) -> Column:
    """Diacritics put back by rule: an opening `ia` (or after one of the prefixes, the first that fits), a closing `ain`."""
    w = F.lower(c)
    opened = F.when(w.startswith("ia"), F.concat(F.lit("ï"), F.substr(w, F.lit(2))))
    for p in before:
        opened = opened.when(w.startswith(p + "ia"), F.concat(F.lit(p + "ï"), F.substr(w, F.lit(len(p) + 2))))
    return F.regexp_replace(opened.otherwise(w), "ain$", "aiñ")


def match_case(original: Column, replacement: Column) -> Column:
    """replacement in the case of original: all capitals (two letters or more), an initial capital, or as it is."""
    letters = F.regexp_replace(original, r"[^\p{L}]", "")
    upper = (F.length(letters) > 1) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    head = F.substr(letters, F.lit(1), F.lit(1))
    at = F.regexp_instr(replacement, F.lit(r"\p{L}"))
    raised = F.concat(F.substr(replacement, F.lit(1), at - 1), F.upper(F.substr(replacement, at, F.lit(1))), F.substr(replacement, at + 1))
    empty = (F.coalesce(original, F.lit("")) == "") | (F.coalesce(replacement, F.lit("")) == "")
    return F.when(empty, replacement).when(upper, F.upper(replacement)).when((head != "") & (head == F.upper(head)) & (head != F.lower(head)) & (at > 0), raised).otherwise(replacement)


def restore_case(original: Column, corrected: Column) -> Column:
    """Only the first character decides."""
    head = F.substr(original, F.lit(1), F.lit(1))
    return F.when((head == F.upper(head)) & (head != F.lower(head)), F.concat(F.upper(F.substr(corrected, F.lit(1), F.lit(1))), F.substr(corrected, F.lit(2)))).otherwise(corrected)


def phonemes(c: Column, digraphs: tuple[str, ...]) -> Column:
    """The word's units, longest digraphs first, lower-cased."""
    units = "|".join(map(re.escape, sorted(digraphs, key=len, reverse=True)))
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?s)({units}|.)"), F.lit(1))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading units two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")


def first_letter_differs(a: Column, b: Column) -> Column:
    head = lambda c: fold_marks(F.lower(F.substr(c, F.lit(1), F.lit(1))))
    return (head(a) != head(b)).cast("int")


def skeleton(c: Column, profile: LanguageProfile) -> Column:
    """The word without its vowels."""
    return F.translate(c, profile.vowels, "")


def gloss_line(glosses: Column) -> Column:
    return F.trim(F.regexp_replace(F.concat_ws(" ", glosses), r"\s+", " "))


def without_brackets(c: Column) -> Column:
    """The text with bracketed parts taken out, white space folded."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\([^()]*\)|\[[^\[\]]*\]", " "), r"\s+", " "))


def bracketed(c: Column) -> Column:
    """The bracketed parts, without their brackets."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\([^()]*\)|\[[^\[\]]*\]"), F.lit(0)), lambda x: F.trim(F.substr(x, F.lit(2), F.length(x) - 2)))


def double_i(c: Column) -> Column:
    """`ii` and `iï` as `ïi`."""
    return F.regexp_replace(c, "i[iï]", "ïi")


def opening_ia(c: Column) -> Column:
    """An opening `ia` as `ïa`, in its case."""
    return F.regexp_replace(F.regexp_replace(c, "^ia", "ïa"), "^I([aA])", "Ï$1")


def senses(gloss: Column) -> Column:
    """A gloss string as its senses: parts between semicolons, trimmed, without empty ones and bracketed notes."""
    return F.filter(F.transform(F.split(gloss, ";"), without_brackets), lambda x: x != "")


def imitatives(c: Column) -> Column:
    """The texts of `[Imit. ...]` notes."""
    return F.regexp_extract_all(c, F.lit(r"\[Imit\.\s*([^\]]*)\]"), F.lit(1))


# Names of the parts of speech.
POS = {"n": "NOUN", "noun": "NOUN", "v": "VERB", "verb": "VERB", "adj": "ADJ", "adjective": "ADJ", "adv": "ADV", "adverb": "ADV", "pron": "PRON", "pronoun": "PRON", "prep": "PREP", "preposition": "PREP", "conj": "CONJ", "num": "NUM", "numeral": "NUM"}


def canonical_pos(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    table = F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])
    return F.coalesce(F.element_at(table, low), F.upper(low))


def is_reduplication(c: Column) -> Column:
    parts = F.split(c, "-")
    return (F.size(parts) == 2) & (parts[0] == parts[1]) & (parts[0] != "")


def is_multi_word(c: Column) -> Column:
    return F.size(F.split(F.trim(c), r"\s+")) > 1


def clean_token(c: Column) -> Column:
    """Lower-case letters and inner hyphens, 2 to 25 characters."""
    return c.rlike(r"^[a-zïñáéíóúý]+(?:-[a-zïñáéíóúý]+)*$") & F.length(c).between(2, 25)
