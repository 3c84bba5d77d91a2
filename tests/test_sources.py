import gzip
import json

import pytest
from pyspark.sql import functions as F

from morphlake.sources import io


def put(path, value):
    path.write_text(json.dumps(value) if not isinstance(value, str) else value, encoding="utf-8")
    return str(path)


def words(df):
    return sorted(r.word for r in df.collect())


def test_word_lists_of_either_shape(spark, tmp_path):
    assert words(io.word_list(spark, put(tmp_path / "g.json", {"meta": 1, "tokens": {"Una": "places", "Ola": "names"}}))) == ["Ola", "Una"]
    assert words(io.word_list(spark, put(tmp_path / "e.json", {"words": {"the": 9, "of": 7}}), "words")) == ["of", "the"]
    assert words(io.word_list(spark, put(tmp_path / "a.json", {"tokens": ["x", "y"]}))) == ["x", "y"]
    assert io.word_list(spark, str(tmp_path / "none.json")).count() == 0
    with pytest.raises(Exception, match="no words under tokens"):
        io.word_list(spark, put(tmp_path / "bad.json", {"other": 1})).collect()


def test_counts_links_and_pairs(spark, tmp_path):
    for shape in ({"counts": {"ka": 3, "u": 2}}, {"ka": 3, "u": 2}):
        assert sorted((r.word, r["count"]) for r in io.word_counts(spark, put(tmp_path / "c.json", shape)).collect()) == [("ka", 3), ("u", 2)]
    links = io.spelling_links(spark, put(tmp_path / "l.json", {"links": {"a": ["b", "c"], "d": []}}))
    assert sorted((r.word, r.variant) for r in links.collect()) == [("a", "b"), ("a", "c")]
    pairs = io.word_pairs(spark, put(tmp_path / "p.csv", "wrong_word,correct_word\nteh,the\n"))
    assert [tuple(r) for r in pairs.collect()] == [("teh", "the")]
    review = io.reviewed_splits(spark, put(tmp_path / "r.csv", "surface,count,split_as\nabc,3,a bc\n"))
    assert [r.asDict() for r in review.collect()] == [{"surface": "abc", "split_as": "a bc", "count": "3", "phrase_count": None, "verdict": None}]
    assert io.reviewed_splits(spark, str(tmp_path / "none.csv")).count() == 0


def test_lines_of_all_files(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    put(tmp_path / "in" / "a.txt", "one\ntwo\n")
    put(tmp_path / "in" / "deep" / "b.txt", "three")
    with gzip.open(tmp_path / "in" / "c.txt.gz", "wt") as f:
        f.write("four")
    assert sorted(r.line for r in io.text_lines(spark, str(tmp_path / "in")).collect()) == ["four", "one", "three", "two"]


def test_gram_store(spark, tmp_path):
    flat = spark.createDataFrame([("a", 1, 5), ("a\tb", 2, 3), ("a\tb\tc", 3, 2)], "gram string, n int, count long")
    io.save_grams(flat, str(tmp_path / "grams"))
    got = io.load_grams(spark, str(tmp_path / "grams"))
    assert [tuple(r) for r in got["tri"].collect()] == [("a", "b", "c", 2)] and [tuple(r) for r in got["uni"].collect()] == [("a", 5)]
    new = spark.createDataFrame([("a", 1, 6), ("z", 1, 1)], "gram string, n int, count long")
    assert sorted(tuple(r) for r in io.upsert_grams(flat, new).collect()) == [("a", 1, 6), ("a\tb", 2, 3), ("a\tb\tc", 3, 2), ("z", 1, 1)]
    assert sorted(tuple(r) for r in io.upsert_grams(flat, new, prune=True).collect()) == [("a", 1, 6), ("z", 1, 1)]


def test_lexicon_settings_and_first_available(spark, tmp_path, monkeypatch):
    schema = "entry_id string, form struct<surface:string>"
    e = io.lexicon_json(spark, put(tmp_path / "x.json", '{"entry_id": "e1", "form": {"surface": "ka"}}\n'), schema)
    io.save_lexicon(e, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).first().form.surface == "ka"
    monkeypatch.setenv("TAKEN", "env")
    assert io.settings(put(tmp_path / ".env", "# no\nexport A='x'\nTAKEN=file\n")) == {"A": "x", "TAKEN": "env"} and io.settings(str(tmp_path / "no")) == {}
    missing = lambda: spark.read.parquet(str(tmp_path / "missing"))
    assert io.first_available(spark, missing, lambda: e.limit(0), lambda: e).count() == 1 and io.first_available(spark, missing) is None
    assert io.with_columns(e, {"pos": "string"}).columns == ["entry_id", "form", "pos"]


def test_report(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab\ncd teh")], "doc_id int, text string")
    flags = spark.createDataFrame([(1, 6, "teh")], "doc_id int, start int, tok string").withColumn("suggestions", F.expr("array(named_struct('cand', 'the', 'distance', 1D))"))
    io.report(flags, docs, "doc_id", str(tmp_path / "rep"))
    assert [r.value for r in spark.read.text(str(tmp_path / "rep")).collect()] == ["1:2:4 teh -> the"]
