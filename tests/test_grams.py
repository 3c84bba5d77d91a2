import re

import pytest

from morphlake.operators import corpus, grams, lm

TEXT = "\n".join(f"Red stone {'mill' if i % 3 else 'water'} {'ab'[i % 2]}. The mill ran!  Ñandú's red-stone{'' if i % 4 else ' q' * i}. mill" for i in range(20)) + "\nmill red the\n ...\n x. \ty?\nthe mill ran! A\u0085b. the mill ran!\x0b\n<s> the </s>"


def test_slot_scores_of_a_corpus_in_blocks(spark):
    """Whatever the blocks and buckets, slots and scores are those of the joins, and words meet in no join or sum of rows."""
    docs = spark.createDataFrame([(TEXT,), (TEXT[:300],), (None,), ("",)], "text string").repartition(2)
    lines = corpus.lines(docs)
    s = corpus.sentences(corpus.distinct_lines(lines))
    want = lm.slot_scores(lm.contexts(s).select("word", "l2", "l1", "r1", "r2"), corpus.ngrams(s, 1), corpus.ngrams(s, 2, 2), corpus.ngrams(s, 3, 2)).collect()
    want = {(r.word, r.l2, r.l1, r.r1, r.r2): r.slot_score for r in want}
    for size, bucket in ((10, 7), (1 << 18, 1 << 20)):
        df = grams.corpus_slot_scores(lines.distinct(), 6, size, bucket)
        got = df.collect()
        assert len(got) == len(want) and {tuple(r)[:5]: r.slot_score for r in got} == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
        assert not re.search("HashJoin|MergeJoin|Generate", df._jdf.queryExecution().executedPlan().toString())


def test_counts_of_blocks(spark):
    docs = spark.createDataFrame([(TEXT,)], "text string")
    lines = corpus.lines(docs).distinct()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(grams.word_counts(grams.blocks(lines, 10))) == rows(corpus.token_counts(corpus.tokens(lines)))
    assert not grams.corpus_slot_scores(lines.limit(0), 6).collect()


def test_lines_are_trimmed(spark):
    docs = spark.createDataFrame([(" \t\x0ba b\r\n\f \n c \u0085",)], "text string")
    assert [r.line for r in corpus.lines(docs).collect()] == ["a b", " c \u0085"]


def test_realword_in_blocks(spark, monkeypatch):
    """In one block or in several passes of small ones, flags are those of the joins; a slot that stands twice is flagged twice."""
    from pyspark.sql import functions as F

    from morphlake.operators import context, tokens

    docs = spark.createDataFrame([("\n".join(f"the red stone {'mill' if i % 3 else 'water'} {'ab'[i % 2]} stands. a store sold bread {i} times. the store" for i in range(20) for _ in "ab") + "\n" + "\n".join(f"red stone mill {x}" for x in "cdefgh"),)], "text string")
    lines = corpus.lines(docs).withColumn("line", F.concat("line", F.lit(" "), F.monotonically_increasing_id().cast("string"))).select("line").distinct()
    s, cnt = corpus.sentences(lines.select(F.md5("line").alias("md5"), "line")), corpus.token_counts(corpus.tokens(lines))
    lx = cnt.where("count >= 5").select(F.col("word").alias("entry_id"), F.col("word").alias("surface"), F.col("word").alias("root"))
    texts = spark.createDataFrame([("k1", "The red store mill a stands."), ("k2", "The red store mill a stands. A stone sold bread."), ("k3", "the red stone mill Stone zz")], "key string, text string")
    spans = tokens.sentence_index(tokens.word_spans(texts, "text", "key"), ["key"])
    args = ("key", "abcdefghijklmnopqrstuvwxyz", 2.0)
    rows = lambda df: sorted(tuple(round(x, 3) if isinstance(x, float) else x for x in r) for r in df.collect())
    want = rows(context.realword(spans, lx, cnt, corpus.ngrams(s, 1), corpus.ngrams(s, 2, 2), corpus.ngrams(s, 3, 2), *args))
    assert {(r[0], r[4], r[5]) for r in want} >= {("k1", "store", "stone"), ("k2", "store", "stone")}
    assert rows(context.corpus_realword(spans, lx, cnt, grams.model(grams.blocks(lines)), *args)) == want
    monkeypatch.setattr(grams, "passes", lambda _: 6)
    better = grams.better_fits
    monkeypatch.setattr(grams, "better_fits", lambda *a: better(*a, 2))
    assert rows(context.corpus_realword(spans, lx, cnt, grams.model(grams.blocks(lines, 30), 50), *args)) == want
