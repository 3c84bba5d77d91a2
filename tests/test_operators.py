import math

import pytest
from pyspark.sql import functions as F

from morphlake.operators import check, context, corpus, frequency, fuzzy, lexicon as lex, lm, metrics, morphology, names, pool, repair, tokens, variants, vectors
from morphlake.profile import SAMPLE


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


@pytest.fixture(scope="module")
def entries(spark):
    data = [("e1", "stone", "stone", "noun"), ("e2", "red", "red", "adj"), ("e3", "legal", "legal", "adj"), ("e4", "paint", "paint", "verb"), ("e5", "piñata", "piñata", "noun"), ("e6", "red stone", "stone", "noun"), ("e7", "run", "run", "verb"), ("e8", "water", "water", "noun"), ("e12", "mill", "mill", "noun")]
    return spark.createDataFrame([(i, s, r, p, [f"a {s}"], False) for i, s, r, p in data], "entry_id string, surface string, root string, pos string, gloss array<string>, needs_review boolean")


def words(spark, *w):
    return spark.createDataFrame([(x,) for x in w], "word string")


def test_corpus_and_model(spark):
    docs = spark.createDataFrame([("The cat sat. The cat ran!\nThe cat sat. The cat ran!\n\n  x  ",), (None,)], "text string")
    unique = corpus.distinct_lines(corpus.lines(docs))
    assert rows(unique, "line", "copies") == [("The cat sat. The cat ran!", 2), ("x", 1)]
    assert rows(corpus.corpus_stats(docs)) == [(3, 2, 7, 5, 3, 1.5)]
    s = corpus.sentences(unique)
    uni, bi, tri = corpus.ngrams(s, 1), corpus.ngrams(s, 2, 2), corpus.ngrams(s, 3, 2)
    assert {r.w1: r["count"] for r in uni.collect()} == {"<s>": 6, "</s>": 3, "the": 2, "cat": 2, "sat": 1, "ran": 1, "x": 1}
    assert rows(tri) == [("<s>", "<s>", "the", 2), ("<s>", "the", "cat", 2)]
    got = {(r.v, r.w): r.s2 for r in lm.bigram_scores(spark.createDataFrame([("the", "cat"), ("cat", "the"), ("zz", "qq")], "v string, w string"), uni, bi).collect()}
    assert got == {("the", "cat"): 1.0, ("cat", "the"): pytest.approx(0.4 * 2 / 7), ("zz", "qq"): pytest.approx(0.4e-10)}
    slot = spark.createDataFrame([("cat", "<s>", "the", "sat", "</s>")], "word string, l2 string, l1 string, r1 string, r2 string")
    # <s> the cat: 2/2; the cat sat: backs off twice to sat; cat sat </s>: backs off twice to the unseen-as-unigram end
    want = math.log(1.0) + math.log(0.4 * 0.4 * 1 / 7) + math.log(0.4 * 0.4 * 3 / 7)
    assert lm.slot_scores(slot, uni, bi, tri).first().slot_score == pytest.approx(want)


def test_frequency(spark):
    assert [r[0] for r in spark.createDataFrame([(1,), (4,), (100,)], "c long").select(frequency.scale(F.col("c"))).collect()] == [2, 5, 13]
    table = spark.createDataFrame([("a", 20), ("ñu", 20), ("zz", 25), ("q", None)], "word string, pseudo long")
    cnt = spark.createDataFrame([("a", 3), ("nu", 10)], "word string, count long")
    assert rows(frequency.remap(table, cnt), "word", "frequency", "source") == [("a", 4, "attested"), ("q", 1, "absent"), ("zz", 3, "absent"), ("ñu", 7, "inherited")]
    out = dict(rows(frequency.expand(spark.createDataFrame([("legal", 30), ("relegal", 2)], "word string, frequency long"), SAMPLE)))
    assert out["illegal"] == 9 and out["relegal"] == 2 and out["tolegal"] == 7


def test_lexicon(spark, entries):
    got = {r.word: (r.entry_id, r.matched_on) for r in lex.lookup(words(spark, "stone", "pinata", "Red", "zz"), entries).collect()}
    assert got == {"stone": ("e1", "surface"), "pinata": ("e5", "fold"), "Red": ("e2", "surface"), "zz": (None, None)}
    assert rows(lex.compound_hosts(entries)) == [("red", ["red stone"], 1), ("stone", ["red stone"], 1)]
    assert {r.word: r.is_known for r in lex.is_known(words(spark, "pinata", "STONE", "zz"), entries).collect()} == {"pinata": True, "STONE": True, "zz": False}
    assert lex.next_entry_id(entries).first()[0] == "e13"
    new = spark.createDataFrame([("e1", "rock"), ("e99", "new")], "entry_id string, surface string")
    old = entries.select("entry_id", "surface").where("entry_id in ('e1', 'e2')")
    assert rows(lex.upsert(old, new)) == [("e1", "rock"), ("e2", "red"), ("e99", "new")] and rows(lex.upsert(old, new, prune=True)) == [("e1", "rock"), ("e99", "new")]
    assert rows(lex.orphans(old, new)) == [("e2", "red")] and rows(lex.delete(old, new)) == [("e2", "red")]
    p = {r.word: r.pseudo for r in lex.pseudo_frequency(entries).collect()}
    assert p["stone"] == 20 and p["red stone"] >= 12
    twice = entries.where("entry_id = 'e1'").union(entries.where("entry_id = 'e2'").withColumn("surface", F.lit("Stone")))
    assert rows(lex.merge_same_surface(twice), "entry_id", "gloss") == [("e1", ["a stone", "a red"])]
    assert lex.stats(entries).first().asDict() == {"entries": 9, "surfaces": 9, "roots": 8, "needs_review": 0, "phrases": 1, "bare": 8, "classes": 3}


def test_fuzzy(spark):
    forms = words(spark, "stone", "store", "tone", "bang")
    pairs = fuzzy.candidates(words(spark, "stnoe", "ban"), fuzzy.delete_index(forms))
    assert ("stnoe", "stone") in rows(pairs) and ("ban", "bang") in rows(pairs)
    freq = spark.createDataFrame([("store", 50)], "word string, frequency long")
    got = rows(fuzzy.ranked(words(spark, "stnoe", "ban"), forms, freq, SAMPLE), "query", "rank", "cand", "distance")
    assert ("stnoe", 1, "stone", 1.0) in got and ("ban", 1, "bang", 0.5) in got
    pairs = [("abc", "ab", True), ("abc", "acb", True), ("abc", "abd", True), ("abc", "abcd", True), ("abc", "abc", False), ("abc", "cba", False), ("ab", "ba", True), ("abcd", "badc", False), ("a", "", True)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(fuzzy.one_edit(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]
    cnt = spark.createDataFrame([("teh", 2), ("the", 90), ("tea", 11), ("a", 1), ("b", 9)], "word string, count long")
    assert rows(fuzzy.dominant_neighbour(cnt)) == [("a", "b", 9), ("teh", "the", 90)]
    assert rows(fuzzy.swapped_known(words(spark, "teh"), words(spark, "the"))) == [("teh", "the")]
    reviewed = spark.createDataFrame([("ab", "a b", "2", "4", ""), ("cd", "c d", "9", "0", "Split"), ("ef", "e f", "1", "9", "keep"), ("gh", "g h", "x", "1", None)], "surface string, split_as string, count string, phrase_count string, verdict string")
    assert rows(fuzzy.split_table(reviewed)) == [("ab", "a b"), ("cd", "c d")]
    bi = spark.createDataFrame([("red", "stone", 7)], "w1 string, w2 string, count long")
    cnt = spark.createDataFrame([("redstone", 6), ("red", 9), ("stone", 9)], "word string, count long")
    assert rows(fuzzy.runtogether(cnt, bi, words(spark, "red", "stone"))) == [("redstone", "red stone", 6, 7, "")]
    lx = spark.createDataFrame([("red", "adj"), ("stone", "noun")], "word string, pos string")
    assert rows(fuzzy.compound_splits(words(spark, "redstone"), lx, SAMPLE)) == [("redstone", "red", "stone", True, "ADJ+N")]


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "He ran. \"Stop!\" it’s\nA: mail a.b@c.org or www.x.com/y, w0rd B52")], "id int, text string")
    spans = tokens.sentence_index(tokens.word_spans(docs, "text", "id"), ["id"])
    got = [(r.tok, r.sentence) for r in spans.orderBy("pos").collect()]
    assert got[:6] == [("He", 0), ("ran", 0), ("Stop", 1), ("it’s", 2), ("A", 3), ("mail", 3)]
    first = [r.tok for r in spans.where("initial").orderBy("pos").collect()]
    assert first[:5] == ["He", "Stop", "it’s", "A", "mail"]
    t = docs.first().text
    assert {(r.kind, t[r.start : r.end]) for r in tokens.unchecked_spans(docs, "text", "id").collect()} >= {("address", "a.b@c.org"), ("url", "www.x.com/y,"), ("digit_word", "w0rd"), ("code", "B52")}
    e = spark.createDataFrame([(1, 0, 2, "She"), (1, 1, 4, "XX"), (1, 3, 6, "walked")], "id int, start int, end int, replacement string")
    assert tokens.splice(docs, e, "id").first().corrected.startswith('She walked. "Stop!"')
    assert docs.select(tokens.line_column(F.col("text"), F.lit(t.index("A:"))).alias("p")).first().p.asDict() == {"line": 2, "col": 1}


def test_names_and_pool(spark, entries):
    t = spark.createDataFrame([("Anna", True), ("ANNA", True), ("Bob", False), ("Bob", True), ("x", False)], "tok string, initial boolean")
    assert [r.name_class for r in names.classify(t, words(spark, "anna")).orderBy("tok", "initial").collect()] == ["name", "name", "capitalised", None, None]
    assert rows(names.capitalisation(t)) == [("anna", 0, 1), ("bob", 0, 2), ("x", 1, 0)]
    cnt = spark.createDataFrame([("stone", 50), ("rare", 1), ("qart", 30), ("sandal", 40), ("sandla", 21), ("pinata", 30), ("happy", 30), ("1a", 30)], "word string, count long")
    got = dict(rows(pool.decide(cnt.union(spark.createDataFrame([("sandals", 300)], "word string, count long")), entries, SAMPLE, banned="q"), "word", "reason"))
    assert got == {"stone": "in_lexicon", "rare": "below_floor", "qart": "banned_letter", "sandal": "dominated", "sandla": "admitted", "sandals": "phonotactic", "pinata": "in_lexicon", "happy": "phonotactic", "1a": "foreign_char"}


def test_morphology(spark, entries):
    lx = spark.createDataFrame([("paint", "verb"), ("red", "adj"), ("stone", "noun"), ("mill", "noun")], "word string, pos string")
    got = {r.word: (r.status, r.root, r.score) for r in morphology.parse(words(spark, "repaint", "painting", "red", "rerepaint", "anrepaint", "zz"), lx, SAMPLE).collect()}
    assert got["red"] == ("direct_match", "red", 3.0) and got["repaint"] == ("derived_form", "paint", 2.2) and got["painting"] == ("suffix_stripped", "paint", 1.9)
    assert got["anrepaint"] == ("stacked_form", "paint", 2.65) and "zz" not in got
    kinds = dict(rows(morphology.complex_words(words(spark, "red-red", "red-and-red", "red-stone", "tik-tok", "a-b-b", "redstone"), lx, SAMPLE), "word", "type"))
    assert kinds == {"red-red": "total_reduplication", "red-and-red": "reduplication_interfix_A", "red-stone": "compound_hyphenated", "tik-tok": "partial_reduplication_vowel", "a-b-b": "triplication", "redstone": "compound_fusion"}
    made = morphology.generate(words(spark, "repaimt"), lx.select("word"), lx.select("word"), SAMPLE)
    assert ("repaimt", "repaint") in rows(made, "query", "cand")


def test_check(spark, entries):
    r = check.Resources(entries, SAMPLE, taught=words(spark, "zork"), foreign=words(spark, "house"), splits=spark.createDataFrame([("redrun", "red run")], "surface string, split_as string"))
    out = {x.word: x for x in check.check(words(spark, "stone", "Stnoe", "zork", "house", "", "x" * 60, "sh", "redrun", "rerepaint", "stоne", "repaint"), r).collect()}
    method = {k[:9]: v.method for k, v in out.items()}
    assert method == {"stone": "confidence_gate", "Stnoe": method["Stnoe"], "zork": "user_dictionary", "house": "english_word", "": "empty", "x" * 9: "too_long", "sh": "semantically_invalid_standalone", "redrun": "runtogether_split", "rerepaint": "doubled_prefix", "stоne": "lookalike_letters", "repaint": "confidence_gate"}
    assert out["Stnoe"].suggestions[0].cand == "stone" and out["redrun"].suggestions[0].cand == "red run" and out["stоne"].suggestions == []
    docs = spark.createDataFrame([(1, "The Stnoe is stnoe."), (2, None)], "doc_id int, text string")
    flags = check.check_text(docs, check.teach(r, words(spark, "the", "is")))
    fixed = {x.doc_id: x.corrected for x in check.correct_text(docs, flags).collect()}
    assert fixed == {1: "The Stone is stone.", 2: None}


def test_context(spark, entries):
    docs = spark.createDataFrame([("red stone mill\n" + "\n".join(f"red stone water {i}" for i in range(30)) + "\n" + "\n".join(f"run mill paint {i}" for i in range(9)),)], "text string")
    s = corpus.sentences(corpus.lines(docs).select("line", F.md5(F.concat("line", F.lit(""))).alias("md5")))
    model = corpus.ngrams(s, 1), corpus.ngrams(s, 2, 2), corpus.ngrams(s, 3, 2)
    c = spark.createDataFrame([("f", 1, "water", "<s>", "red", "water", "</s>", "m"), ("f", 2, "stone", "<s>", "red", "water", "</s>", "m")], "flag string, rank int, cand string, l2 string, l1 string, r1 string, r2 string, method string")
    assert dict(rows(context.rerank(c, *model), "cand", "new_rank")) == {"stone": 1, "water": 2}
    lx = entries.unionByName(entries.where("entry_id = 'e1'").withColumns({"surface": F.lit("store"), "root": F.lit("store"), "entry_id": F.lit("e50")}))
    cnt = spark.createDataFrame([("stone", 31), ("store", 1), ("red", 30), ("water", 30)], "word string, count long")
    assert rows(context.confusion_sets(words(spark, "store"), lx, cnt, "abcdefghijklmnopqrstuvwxyz"), "word", "alternative") == [("store", "stone")]
    spans = tokens.sentence_index(tokens.word_spans(spark.createDataFrame([(1, "red store water")], "key int, text string"), "text", "key"), ["key"])
    assert rows(context.realword(spans, lx, cnt, *model, "key", "abcdefghijklmnopqrstuvwxyz", 2.0), "tok", "suggestion") == [("store", "stone")]


def test_variants_and_repair(spark, entries):
    got = rows(variants.find(words(spark, "pinata", "stone"), entries, SAMPLE), "word", "variant", "source", "canonical")
    assert got == [("pinata", "piñata", "lexicon", True)]
    bad = entries.where("entry_id in ('e1', 'e2', 'e3')").withColumn("surface", F.when(F.col("entry_id") == "e1", "red-").when(F.col("entry_id") == "e3", "legal (adj.)").otherwise(F.col("surface")))
    out = repair.outcomes(bad)
    assert rows(out, "entry_id", "rule", "outcome") == [("e1", "trailing_hyphen", "conflict"), ("e2", None, "keep"), ("e3", "brackets", "rewrite")]
    kept, gone = repair.apply(out)
    assert rows(kept, "surface") == [("legal",), ("red",), ("red-",)] and gone.count() == 0
    one = spark.createDataFrame([(["a (b", "c)", "d"],)], "g array<string>")
    assert one.select(repair.merge_pieces(F.col("g"))).first()[0] == ["a (b, c)", "d"]


def test_vectors_and_metrics(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 3.0]), (3, [0.0, 0.0])], "vec_id int, embedding array<double>")
    assert rows(vectors.top_neighbours(v.where("vec_id = 0"), v.where("vec_id < 3"), 1), "query", "neighbour") == [(0, 1)]
    assert v.select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0), F.lit(0.0)))).collect()[3][0] == -1.0
    d = spark.createDataFrame([(True, True), (True, False), (False, False), (False, True)], "is_error boolean, flagged boolean")
    assert metrics.detection(d).first().asDict() == {"tp": 1, "fn": 1, "fp": 1, "tn": 1, "precision": 0.5, "recall": 0.5, "f1": 0.5, "specificity": 0.5, "accuracy": 0.5}
    c = metrics.correction(spark.createDataFrame([(1,), (4,), (11,), (None,)], "rank int")).first()
    assert (c.top1, c.top5, c.mrr, c.never) == (0.25, 0.5, 0.3125, 2)
    p = metrics.sign_test(spark.createDataFrame([(24, 6), (0, 0), (5, 5)], "fixed long, broken long")).collect()
    assert [r.p_value for r in p] == [pytest.approx(0.00143, abs=1e-5), 1.0, 1.0]


def test_sign_test_of_many_items(spark):
    """Sums of binomials beyond a double's range, against whole numbers."""
    pairs = [(700, 600), (2713, 1990), (4100, 4000), (12000, 12001)]
    p = metrics.sign_test(spark.createDataFrame(pairs, "fixed long, broken long")).collect()
    want = [min(1.0, 2 * sum(math.comb(a + b, i) for i in range(min(a, b) + 1)) / 2 ** (a + b)) for a, b in pairs[:3]] + [1.0]
    assert [r.p_value for r in p] == pytest.approx(want, abs=2e-9)


def test_two_deletion_queries_equal_brute_force(spark, tmp_path):
    """The registered queries reach pairs that are two deletions apart."""
    from itertools import combinations

    from morphlake.plans import catalog

    floor = catalog.FLOOR
    known, rare = ["stone", "house", "ab", "planet"], ["stnoe", "sto", "hosue", "housexy", "pl", "zzz", "abcd"]
    text = " ".join(w for w in known for _ in range(floor)) + " " + " ".join(rare)
    documents = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars int")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    dels = lambda w: {"".join(c) for k in (0, 1, 2) for c in combinations(w, len(w) - k) if len(w) > k}
    found = catalog.queries()
    index = {(r.deletion, r.word) for r in found["delete_index_two"](spark, str(tmp_path)).collect()}
    assert index == {(x, w) for w in known for x in dels(w)}
    pairs = {(r.query, r.cand) for r in found["fuzzy_candidates_two"](spark, str(tmp_path)).collect()}
    assert pairs == {(q, c) for q in rare for c in known if dels(q) & dels(c)}
    assert ("sto", "stone") in pairs and ("housexy", "house") in pairs


def test_word_spans_leave_in_bounded_batches(spark, monkeypatch):
    """A text of more tokens than are held at a time gives the same rows; no batch is larger."""
    import pyarrow as pa

    monkeypatch.setattr(tokens, "SPANS", 3)
    seen = []

    class Docs:
        schema = spark.createDataFrame([], "id int, text string").schema

        def select(self, *_):
            return self

        def mapInArrow(self, scan, _):
            batch = pa.RecordBatch.from_arrays([pa.array([7, 8, 9], pa.int32()), pa.array(["A b. C d e", None, "f g h"])], ["id", "__text"])
            seen.extend(scan(iter([batch])))

    tokens.word_spans(Docs(), "text", "id")
    assert [b.num_rows for b in seen] == [3, 3, 2]
    got = [tuple(r.values()) for b in seen for r in b.to_pylist()]
    assert got[:3] == [(7, 0, "A", 0, 1, "", True), (7, 1, "b", 2, 3, " ", False), (7, 2, "C", 5, 6, ". ", True)]
    assert got[5:] == [(9, 0, "f", 0, 1, "", True), (9, 1, "g", 2, 3, " ", False), (9, 2, "h", 4, 5, " ", False)]


def test_scores_in_passes(spark):
    """Scores taken in several passes are those of one."""
    docs = spark.createDataFrame([("\n".join(f"red stone {'mill' if i % 3 else 'water'} {'ab'[i % 2]}. the mill ran" for i in range(20)) + "\nmill red the",)], "text string")
    s = corpus.sentences(corpus.distinct_lines(corpus.lines(docs)))
    model = corpus.ngrams(s, 1), corpus.ngrams(s, 2, 2), corpus.ngrams(s, 3, 2)
    for f, arg in ((lm.sentence_logprob, s), (lm.slot_scores, lm.contexts(s).select("word", "l2", "l1", "r1", "r2"))):
        rounded = lambda n: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in f(arg, *model, n).collect())  # noqa: B023, E731
        one = rounded(1)
        assert one == rounded(3) and len({r[:5] if len(r) == 6 else r[:2] for r in one}) == len(one)
    assert {r.n_tokens for r in lm.sentence_logprob(s, *model, 3).where("position = 1").collect()} == {3}


def test_written_tables_leave_no_shuffle_files_and_are_not_broadcast(spark, monkeypatch):
    from morphlake.sources import store

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(conf, None)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {b.toString() for b in map(disk.getAllBlocks().apply, range(disk.getAllBlocks().size())) if b.toString().startswith("shuffle")}
    old = files()
    counts = spark.range(5000).select((F.col("id") % 1000).cast("string").alias("word")).groupBy("word").count()
    small = store.written(counts, "small")
    assert small.count() == 1000 and spark.conf.get(conf, None) == before
    monkeypatch.setattr(store, "LARGE", 100)
    large = store.written(counts, "large")
    plan = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    assert "BroadcastHashJoin" in plan(counts.join(small, "word")) and "SortMergeJoin" in plan(counts.join(large, "word"))
    for _ in range(50):
        left = {x for x in files() - old if not x.startswith("shuffle_merged")}
        if not left:
            break
        __import__("time").sleep(0.1)
    assert len({x.split("_")[1] for x in left}) <= 1  # that of the count above
