import os
import random
import re
import subprocess
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import test_minhash, test_secret_scan

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def documents():
    rng = random.Random(12)
    vocab = ["word%d" % i for i in range(3000)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = prose(55)
    rows = [prose(rng.randint(3, 90)) for _ in range(80)]
    rows[10] += "\n" + passage + "\n" + prose(9)
    rows[33] = prose(20) + "\n" + passage
    rows[40] = rows[41] + " tail"
    rows[50] += ' token = "%s" ' % ("0123456789abcdef" * 3)
    rows += [None, "", "12345 !!!", rows[3], rows[2].upper()]
    return [(i, t, rng.choice(["en", None]), "s%d" % (i % 3), len(t or "")) for i, t in enumerate(rows)]


def brute(rows):
    docs = {i: t for i, t, *_ in rows if t and any(map(str.isalpha, t))}
    groups = test_minhash.brute(list(docs.items()))
    docs = {i: t for i, t in docs.items() if groups[i][1] == i}
    data = {i: t.encode() for i, t in docs.items()}
    at = {}
    for i, b in data.items():
        for p in range(len(b) - 199):
            at.setdefault(b[p : p + 200], []).append((i, p))
    gone = {i: bytearray(len(b)) for i, b in data.items()}
    for where in at.values():
        if len(where) > 1:
            for i, p in where:
                gone[i][p : p + 200] = b"\1" * 200
    docs = {i: bytes(c for c, g in zip(b, gone[i], strict=True) if not g).decode("utf-8", "ignore") for i, b in data.items()}
    for i, t in docs.items():
        spans = []
        for _, s, e in test_secret_scan.brute(t):
            if spans and s < spans[-1][1]:
                spans[-1][1] = max(e, spans[-1][1])
            else:
                spans.append([s, e])
        for s, e in reversed(spans):
            t = t[:s] + "[SECRET]" + t[e:]
        docs[i] = t
    return docs


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == names, name
    want = brute(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}
    assert got.keys() == want.keys()
    assert all(n == len(t) for t, n in got.values())
    assert "[SECRET]" in got[50][0] and "0123456789abcdef" not in got[50][0]
    assert {i: t for i, (t, _) in got.items()} == want
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    assert {r.doc_id: r.length for r in out} == sizes
    assert len({r.sequence_id for r in out}) == -(-np.sum(list(sizes.values())) // 4096)


def test_entry_without_these_folders(tmp_path):
    """The rest still imports after corpus_pipeline.py and the subpackage are deleted."""
    subprocess.run(["cp", "-r", f"{ROOT}/morphlake", f"{ROOT}/__spark_entry__.py", str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", f"{tmp_path}/morphlake/llm"], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(re.match(r'op\\d', n) for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", "import re; " + code], cwd=tmp_path, check=True)


def test_near_dedup_takes_pairs_from_four_fifths(spark):
    rng = random.Random(4)
    rows, shares = [], []
    for i, changed in enumerate([5, 6, 6, 5, 6, 8, 9]):
        words = ["w%d" % rng.randrange(9000) for _ in range(300)]
        other = list(words)
        for k in range(changed):
            other[20 + 30 * k] = "changed%d" % k
        a, b = ({tuple(x[j : j + 5]) for j in range(296)} for x in (words, other))
        shares.append(len(a & b) / len(a | b))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    assert all(0.8 < x < 0.85 for x in shares[:5]) and all(x < 0.8 for x in shares[5:])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [0, 2, 4, 6, 8, 10, 11, 12, 13]


def test_stages_take_clashing_names_empty_tables_and_odd_ids(spark):
    rng = random.Random(3)
    prose = lambda n: " ".join("word%d" % rng.randrange(2000) for _ in range(n))
    text = prose(120)
    names = "digest copies spans gone lang_pred score __digest __copies __spans __drop row key h asked id piece length".split()
    rows = [(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, prose(60), None, None, None), (None, text + " x", "en", "s", 2), (2, None, "en", "s", 0), (3, "", None, "s", 0), (4, prose(80) + " password=abcdefgh12345", "en", "s", 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in names)
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], schema)
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == df.columns, name
            kept = out.collect()
            assert all(tuple(r)[5:] == tuple(range(len(names))) for r in kept)
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in corpus_pipeline.near_dedup(spark, df, "").collect())) == sorted((r[0] is None, r[0] or 0) for r in rows)
