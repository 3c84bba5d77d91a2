import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece

from morphlake.llm import piece_bpe as P

PATH = public_tokenizers.path("piece_bpe_32k.model")


def texts(n=300):
    rng = random.Random(6)
    parts = ["Hello", "world", "naïve", " ", "  ", "   ", "\n", "\t", "日本", "𝒳", "the", "ing", "ation", "été", "1234", "!!", "<0x41>", "<s>", "a", "é", "\0", "�"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_rate_zero_equals_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts():
        if t.strip(" ") and "\0" not in t:
            assert P.encode_text(t, PATH, 1, 0, 0.0).tolist() == sp.encode(t), t


def naive(model, unit, seed, variant, rate):
    """The agenda by a plain search for the best untried pair in each step."""
    import xxhash

    parts = [(i, P.SPACE if c == " " else c) for i, c in enumerate(unit)]
    base = xxhash.xxh3_64_intdigest(unit.encode(), (seed * 0x9E3779B1 + variant) & P._M)
    skipped = set()
    while True:
        best = min(((model.score[a[1] + b[1]], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a[1] + b[1] in model.score and (a, b) not in skipped), default=None)
        if best is None:
            break
        k = best[1]
        a, b = parts[k], parts[k + 1]
        h = (base ^ (a[0] * 0x9E3779B97F4A7C15 + len(a[1] + b[1]) * 0xC2B2AE3D27D4EB4F)) & P._M
        h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & P._M
        if ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & P._M < int(rate * (1 << 64)):
            skipped.add((a, b))
        else:
            parts[k : k + 2] = [(a[0], a[1] + b[1])]
    return [x for _, s in parts for x in ([model.id[s]] if s in model.id else [model.byte_id[c] for c in s.encode()])]


def test_dropout_equals_plain_search_and_varies():
    model = P.Model(PATH)
    units = [" internationalization", " responsibilities", "thntation,", " été", " 日本語x", "   abc"]
    for u in units:
        for seed in range(12):
            assert model.segment(u, seed, 1, 0.3) == naive(model, u, seed, 1, 0.3)
    assert len({tuple(model.segment(units[0], s, 0, 0.3)) for s in range(30)}) > 5
    drops = np.mean([model.segment(" the", s, 0, 0.25) != model.segment(" the", 0, 0, 0) for s in range(800)])
    assert 0.15 < drops < 0.7


def test_round_trip(spark):
    rows = [(i, t) for i, t in enumerate(texts(120))] + [(500, None), (501, ""), (502, " "), (503, "▁ literal ▁▁x"), (504, "x" * 60_000), (505, "word " * 40_000), (None, "null id"), (5, "repeated")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int").repartition(3)
    made = P.encode(df, PATH)
    back = P.decode(made, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    crc = {(r.doc_id, zlib.crc32(np.array(r.ids, "<u4").tobytes()), len(r.ids), True) for r in made.collect()}
    assert crc == {(r.doc_id, r.ids_crc32, r.n_ids, r.lossless) for r in P.digest(df, PATH).collect()}
    assert P.digest(df.limit(0), PATH).count() == 0


def test_every_occurrence_and_document_draws_anew(spark):
    model = P.Model(PATH)
    word, n = " internationalization", 2000
    ids = P.encode_text((word * n)[1:], PATH, 1, 7, 0.3).tolist()
    cut, own = [], []
    for i in ids:
        own.append(i)
        if model.decode(own) == word.strip():
            cut.append(tuple(own))
            own = []
    assert len(cut) == n and len(set(cut)) > 50
    rate = 0.1
    plain = tuple(model.segment(" word", rate=0.0))
    many = P.encode_text(("word " * 40_000)[:-1], PATH, 1, 7, rate).tolist()
    assert model.decode(many) == ("word " * 40_000)[:-1] and len(many) > 40_000 * len(plain) * 1.05
    df = spark.createDataFrame([(i, "internationalization responsibilities") for i in range(200)], "doc_id long, text string").repartition(3)
    assert len({tuple(r.ids) for r in P.encode(df, PATH).collect()}) > 20


def test_memo_changes_nothing():
    """The ids of a text do not depend on what was encoded before it."""
    text = " ".join(["the internationalization of responsibilities"] * 50)
    first = P.encode_text(text, PATH, 3, 9, 0.3).tolist()
    assert first == P.encode_text(text, PATH, 3, 9, 0.3).tolist()
    for t in texts(40):
        P.encode_text(t, PATH, 3, 10, 0.3)
    assert first == P.encode_text(text, PATH, 3, 9, 0.3).tolist()
    P._MEMOS.clear()
    assert first == P.encode_text(text, PATH, 3, 9, 0.3).tolist()
    assert first != P.encode_text(text, PATH, 3, 10, 0.3).tolist() != P.encode_text(text, PATH, 4, 10, 0.3).tolist()


def test_side_by_side_equals_one_agenda():
    """merge_all against the heap for each unit, and the query's rows against plain search over every unit."""
    model = P.Model(PATH)
    rng = random.Random(8)
    units = [rng.choice(["", " ", "  "]) + "".join(rng.choice("abcdeinorst▁é日,") for _ in range(rng.randint(1, 20))) for _ in range(500)]
    base = np.array([rng.getrandbits(64) for _ in units], np.uint64)
    for rate in (0.0, 0.3, 1.0):
        limit = int(rate * (1 << 64))
        ids, counts, _, _ = P.merge_all(model, units, base, limit)
        at = 0
        for u, b, n in zip(units, base.tolist(), counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == model.merge(u, b, limit), u
            at += n
    import xxhash

    for t in texts(20):
        want: list[int] = []
        start = np.uint64(xxhash.xxh3_64_intdigest((77).to_bytes(8, "little"), 5))
        for k, u in enumerate(P._UNIT.findall(" " + t)) if t else ():
            turn = P.mix(np.array([(int(start) + k * 0x9E3779B97F4A7C15) & P._M], np.uint64))
            b = P.mix(np.array([xxhash.xxh3_64_intdigest(u.encode())], np.uint64) ^ turn)
            want += model.merge(u, int(b[0]), int(0.2 * (1 << 64)))
        assert P.encode_text(t, PATH, 5, 77, 0.2).tolist() == want
