import random
import re
from collections import Counter

import duckdb

from morphlake.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def data():
    rng = random.Random(8)
    vocab = ["w%d" % i for i in range(60)] + ["é", "𝒳y", "a#", " "]
    rows = []
    for i in range(260):
        t = "".join(rng.choice(vocab) + rng.choice([" ", " ", "\n", "\t\x0b", "  "]) for _ in range(rng.randint(0, 150)))
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s1", "s2", None])))
    rows += [(260, None, "en", "s1"), (261, "", "en", "s1"), (262, "a b a b a b", "xx", "s9"), (263, "word " * 50000, "en", "s1"), (264, "#$% " * 80, "en", "s1"), (265, " lead and trail \n", "en", None)]
    return rows


def test_counts_and_oracle(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, words int").repartition(3)
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert len(got) == len(rows)
    for i, t, _, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(t), i
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words)
    assert not got[264].kept and any(r.kept for r in got.values())
    documents = df.toPandas()  # noqa: F841
    want = duckdb.sql(Q.oracle_sql().replace("from documents", "from documents")).fetchall()
    assert sorted(want) == sorted(tuple(r) for r in got.values())


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s"), (1, "a b", "en", "s")], "doc_id long, text string, lang string, source string")
    assert Q.judge(df).count() == 2 and Q.judge(df.limit(0)).count() == 0


def test_each_rule_rejects_its_outlier(spark):
    """One planted text for each rule, all within the base rules, in a source of plain texts and beside one of a noisy source."""
    rng = random.Random(9)
    vocab = ["word%03d" % i for i in range(900)]
    prose = lambda n: " ".join(rng.sample(vocab, n))
    lines = lambda n: "\n".join(prose(8) for _ in range(n))
    rows = [(i, lines(15), "en", "plain") for i in range(600)]
    noisy = [(1000 + i, lines(12) + " #" * (20 + i % 30), "en", "noisy") for i in range(600)]
    again = prose(8)
    repeated = lines(5)
    bad = {
        "symbols": lines(15) + " ##" * 60, "word_length": " ".join("w" * 30 + str(i) for i in range(120)), "line_repeats": lines(9) + "\n" + "\n".join(["one short line"] * 5),
        "word_repeats": lines(16) + " " + again + " " + again + " " + repeated.replace("\n", " ") + " " + repeated.replace("\n", " "),
    }
    planted = [(2000 + k, t, "en", "plain") for k, t in enumerate(bad.values())]
    df = spark.createDataFrame(rows + noisy + planted, "doc_id long, text string, lang string, source string").repartition(3)
    got = {r.doc_id: r for r in Q.judge(df).collect()}
    assert all(got[r[0]].kept for r in rows + noisy)
    for k, name in enumerate(bad):
        assert not got[2000 + k].base_failed and not got[2000 + k].kept, name
