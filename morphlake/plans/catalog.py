"""The query catalogue: every driver query of the library, with its SQL where SQL can express it.

Each query reads whole tables. The lexicon of the queries is derived from the documents: every type with FLOOR occurrences
or more, with a word class and a gloss made from its text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions import edits, phonetics, phonology, sandhi, text
from morphlake.operators import analysis, check, context, corpus, frequency, fuzzy, grams, lexicon as lex, lm, metrics, morphology, names, pool, repair, tokens, variants, vectors
from morphlake.profile import SAMPLE
from morphlake.sources.store import passes, written
from morphlake.streaming import limits

from . import oracles

FLOOR = 5
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---------------------------------------------------------------- shared inputs

WORD = r"[A-Za-zÏïÑñ]+(?:[''\-][A-Za-zÏïÑñ]+)*"
LINES = r"""lines as (select x as line from (select regexp_replace(unnest(string_split(text, chr(10))), '^\s+|\s+$', '', 'g') as x from documents) where x <> ''),
    uniq as (select md5(line) as md5, min(line) as line, count(*) as copies from lines group by 1)"""
TOKENS = f"{LINES}, tok as (select lower(unnest(regexp_extract_all(line, '{WORD}'))) as word from uniq), cnt as (select word, count(*) as count from tok group by word)"
CLASS = "['noun', 'verb', 'adj', 'adv'][(length(word) % 4 + 1)::int]"
LEXICON = f"{TOKENS}, lexi as (select word as surface, case when length(word) > 6 then left(word, length(word) - 3) else word end as root, {CLASS} as pos, count from cnt where count >= {FLOOR})"
SENTS = rf"""{LINES}, cut as (select md5, line, string_split(regexp_replace(line, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as ss from uniq),
    sent as (select md5, i - 1 as position, list_transform(regexp_extract_all(ss[i], '{WORD}'), lambda w: lower(w)) as t from (select md5, ss, unnest(range(1, len(ss) + 1)) as i from cut)),
    pad as (select md5, position, len(t) as n, ['<s>', '<s>'] || t || ['</s>'] as p from sent where len(t) > 0),
    spot as (select md5, position, n, p, unnest(range(1, len(p) + 1)) as i from pad),
    uni as (select p[i] as w1, count(*) as count from spot group by 1),
    bi as (select p[i] as w1, p[i + 1] as w2, count(*) as count from spot where i < len(p) group by 1, 2 having count(*) >= 2),
    tri as (select p[i] as w1, p[i + 1] as w2, p[i + 2] as w3, count(*) as count from spot where i < len(p) - 1 group by 1, 2, 3 having count(*) >= 2),
    tot as (select sum(count) as total from uni where w1 not in ('<s>', '</s>'))"""


def _s2(v: str, w: str, cv: str, cw: str, cvw: str) -> str:
    return f"case when {cv} > 0 and {cvw} > 0 then {cvw} / {cv} else 0.4 * case when coalesce({cw}, 0) > 0 then {cw} / total else 1e-10 end end"


def _s3() -> str:
    return f"case when uv.count > 0 and t.count > 0 then t.count / uv.count else 0.4 * ({_s2('v', 'w', 'v1.count', 'w1.count', 'vw.count')}) end"


_S3_JOINS = """left join tri t on t.w1 = u and t.w2 = v and t.w3 = w left join bi uv on uv.w1 = u and uv.w2 = v left join bi vw on vw.w1 = v and vw.w2 = w
    left join uni v1 on v1.w1 = v left join uni w1 on w1.w1 = w cross join tot"""


def unique_lines(spark: SparkSession, d: str) -> DataFrame:
    return corpus.distinct_lines(corpus.lines(read(spark, d, "documents")))


def counts(spark: SparkSession, d: str) -> DataFrame:
    return corpus.token_counts(corpus.tokens(unique_lines(spark, d)))


def sents(spark: SparkSession, d: str) -> DataFrame:
    return corpus.sentences(unique_lines(spark, d))


def model(s: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of written sentences, as written tables: a query uses each of them several times. Many grams are counted in passes by their hash."""
    cuts = max(1, passes(s) // 2)

    def table(n: int, least: int) -> DataFrame:
        of = cuts if n > 1 else 1
        out = reduce(DataFrame.unionByName, [written(corpus.ngrams(s, n, least, (k, of) if of > 1 else None), f"grams{n}") for k in range(of)])
        return out.hint("merge") if of > 1 else out  # a union keeps no hint

    return tuple(table(n, least) for n, least in ((1, 1), (2, 2), (3, 2)))


def lexicon(cnt: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Entries made from types: a root of all but three letters where the word is long, a class by its length."""
    w = cnt.where(F.col("count") >= floor)
    root = F.when(F.length("word") > 6, F.substr("word", F.lit(1), F.length("word") - 3)).otherwise(F.col("word"))
    pos = F.element_at(F.array(*map(F.lit, ("noun", "verb", "adj", "adv"))), (F.length("word") % 4 + 1).cast("int"))
    return w.select(F.concat(F.lit("e"), F.md5("word")).alias("entry_id"), F.col("word").alias("surface"), root.alias("root"), pos.alias("pos"), F.array(F.concat(F.lit("gloss of "), "word")).alias("gloss"), F.lit(1.0).cast("decimal(4,3)").alias("confidence"), (F.col("count") < 2 * floor).alias("needs_review"), "count")


def resources(spark: SparkSession, d: str, c: DataFrame | None = None) -> check.Resources:
    """Of the documents' counts, which are written here unless they are given as a written table."""
    c = written(counts(spark, d), "counts") if c is None else c
    return check.Resources(lexicon(c), SAMPLE, frequency=c.where(F.col("count") >= FLOOR).select("word", frequency.scale(F.col("count")).alias("frequency")))


def rare_words(cnt: DataFrame) -> DataFrame:
    """The types below the lexicon's floor."""
    return cnt.where(F.col("count") < FLOOR).select("word")


# ---------------------------------------------------------------- corpus and language model


@query(f"with {TOKENS} select word, count from cnt")
def corpus_token_counts(spark, d):
    return counts(spark, d).orderBy(F.desc("count"), "word")


@query(f"""with {TOKENS} select (select coalesce(sum(copies), 0)::bigint from uniq) as lines_read, (select count(*) from uniq) as lines_kept, coalesce(sum(count), 0)::bigint as tokens, count(*) as types,
    count(*) filter (count = 1) as hapax, round_even((select sum(copies) from uniq) / (select count(*) from uniq), 2) as duplication_factor from cnt""")
def corpus_stats(spark, d):
    return corpus.corpus_stats(read(spark, d, "documents"))


@query(f"with {LINES} select md5, line, copies from uniq")
def line_dedup(spark, d):
    return unique_lines(spark, d)


@query(f"with {SENTS} select w1, w2, count from bi")
def ngram_bigrams(spark, d):
    return corpus.ngrams(sents(spark, d), 2, 2)


@query(f"with {SENTS} select w1, w2, w3, count from tri")
def ngram_trigrams(spark, d):
    return corpus.ngrams(sents(spark, d), 3, 2)


@query(f"""with {SENTS}, flat as (select 1 as n, w1 as gram, count from uni where w1 not in ('<s>', '</s>') union all select 2, w1 || chr(9) || w2, count from bi union all select 3, w1 || chr(9) || w2 || chr(9) || w3, count from tri)
    select n, count(*) as grams, sum(count)::bigint as occurrences from flat group by n""")
def ngram_info(spark, d):
    return corpus.ngram_info(corpus.flat_grams(*model(written(sents(spark, d), "sents"))))


@query(f"""with {SENTS}, pr as (select distinct p[i] as v, p[i + 1] as w from spot where i < len(p)) select v, w, round({_s2("v", "w", "v1.count", "w1.count", "vw.count")}, 6) as s2
    from pr left join bi vw on vw.w1 = v and vw.w2 = w left join uni v1 on v1.w1 = v left join uni w1 on w1.w1 = w cross join tot""")
def lm_bigram_scores(spark, d):
    s = written(sents(spark, d), "sents")
    uni, bi, _ = model(s)
    pairs = corpus.ngrams(s, 2).select(F.col("w1").alias("v"), F.col("w2").alias("w"))
    return lm.bigram_scores(pairs, uni, bi).withColumn("s2", F.round("s2", 6))


@query(f"""with {SENTS}, rq as (select md5, position, n, p[i - 2] as u, p[i - 1] as v, p[i] as w from spot where i > 2)
    select md5, position, n::int as n_tokens, round(sum(ln(greatest({_s3()}, 1e-10))), 6) as logprob from rq {_S3_JOINS} group by md5, position, n""")
def lm_sentence_logprob(spark, d):
    s = written(sents(spark, d), "sents")
    return lm.sentence_logprob(s, *model(s), passes(s)).withColumn("logprob", F.round("logprob", 6))


@query(f"""with {SENTS}, sl as (select distinct p[i] as word, p[i - 2] as l2, p[i - 1] as l1, coalesce(p[i + 1], '</s>') as r1, coalesce(p[i + 2], '</s>') as r2 from spot where i > 2 and i < len(p)),
    rq as (select word, l2, l1, r1, r2, l2 as u, l1 as v, word as w from sl union all select word, l2, l1, r1, r2, l1, word, r1 from sl union all select word, l2, l1, r1, r2, word, r1, r2 from sl)
    select word, l2, l1, r1, r2, round(sum(ln(greatest({_s3()}, 1e-10))), 6) as slot_score from rq {_S3_JOINS} group by word, l2, l1, r1, r2""")
def lm_slot_scores(spark, d):
    return grams.corpus_slot_scores(corpus.lines(read(spark, d, "documents")).distinct(), 6)


# ---------------------------------------------------------------- frequencies, folds, names


@query(f"with {TOKENS} select word, count, round_even(log2(1 + count) * 2, 0)::bigint as scaled from cnt")
def freq_scale(spark, d):
    return counts(spark, d).withColumn("scaled", frequency.scale(F.col("count")))


@query(f"""with {LEXICON}, tab as (select surface as word, least(count, 25) as pseudo from lexi union all select surface || 'ï', 20 from lexi union all select 'zz' || surface, 12 from lexi),
    j as (select t.word, t.pseudo, c.count as own, f.count as folded, translate(t.word, 'ïñáéíóúýÏÑÁÉÍÓÚÝ', 'inaeiouyINAEIOUY') as plain from tab t left join cnt c on c.word = t.word left join cnt f on f.word = translate(t.word, 'ïñáéíóúýÏÑÁÉÍÓÚÝ', 'inaeiouyINAEIOUY'))
    select word, pseudo::bigint as pseudo, case when own is not null then greatest(1, round_even(log2(1 + own) * 2, 0)) when plain <> word and coalesce(folded, 0) > 0 then greatest(1, round_even(log2(1 + floor(folded * 0.9)) * 2, 0))
        else greatest(1, least(3, round_even(pseudo / 25 * 3, 0))) end::bigint as frequency, case when own is not null then 'attested' when plain <> word and coalesce(folded, 0) > 0 then 'inherited' else 'absent' end as source from j""")
def freq_remap(spark, d):
    c = written(counts(spark, d), "counts")
    w = lexicon(c).select(F.col("surface").alias("word"), "count")
    tab = w.select("word", F.least("count", F.lit(25)).cast("long").alias("pseudo")).union(w.select(F.concat("word", F.lit("ï")), F.lit(20).cast("long"))).union(w.select(F.concat(F.lit("zz"), "word"), F.lit(12).cast("long")))
    return frequency.remap(tab, c)


@query(f"""with {TOKENS} select word, translate(translate(word, 'ïñáéíóúý', 'inaeiouy'), '''', '') as fold, translate(word, 'ïñ', 'in') as marks, regexp_replace(word, '[aáeéiíoóuúyýïèêëàâîôûùäöü]', '', 'g') as skeleton,
    array_to_string(regexp_extract_all(word, '(?s)ng|sh|ph|th|kh|bh|dh|jh|lh|rh|.'), '|') as units, regexp_replace(case when starts_with(word, 'ia') then 'ï' || substr(word, 2) when starts_with(word, 'jingia') then 'jingï' || substr(word, 6)
    when starts_with(word, 'pynia') then 'pynï' || substr(word, 5) when starts_with(word, 'nongia') then 'nongï' || substr(word, 6) else word end, 'ain$', 'aiñ') as restored, regexp_replace(word, 'i[iï]', 'ïi', 'g') as double_i from cnt""")
def string_scalars(spark, d):
    w = F.col("word")
    return counts(spark, d).select("word", text.fold_key(w).alias("fold"), text.fold_marks(w).alias("marks"), text.skeleton(w, SAMPLE).alias("skeleton"), F.array_join(text.phonemes(w, SAMPLE.digraphs), "|").alias("units"), text.restore_marks(w).alias("restored"), text.double_i(w).alias("double_i"))


@query(f"""with {LEXICON}, k as (select surface, root, translate(translate(surface, 'ïñáéíóúý', 'inaeiouy'), '''', '') as fold from lexi), q as (select word, translate(translate(word, 'ïñáéíóúý', 'inaeiouy'), '''', '') as f from cnt),
    m as (select word, 0 as k, surface from q join k on word = surface union all select word, 1, surface from q join k on word = root union all select word, 2, surface from q join k on f = fold)
    select word, ['surface', 'root', 'fold'][(b.k + 1)::int] as matched_on, 'e' || md5(b.surface) as entry_id from cnt left join (select word as w, arg_min({{'k': k, 'surface': surface}}, (k, abs(length(surface) - length(word)), surface)) as b from m group by word) on w = word""")
def fold_lookup(spark, d):
    c = written(counts(spark, d), "counts")
    return lex.lookup(c.select("word"), lexicon(c)).select("word", "matched_on", "entry_id")


CASED = f"{LINES}, raw as (select unnest(regexp_extract_all(line, '{WORD}')) as tok from uniq)"


def _cased(spark, d) -> DataFrame:
    return unique_lines(spark, d).select(F.explode(F.regexp_extract_all("line", F.lit(text.PLAIN_WORD), F.lit(0))).alias("tok"))


@query(f"""with {CASED} select lower(tok) as word, count(*) filter (tok = lower(tok)) as lower_count, count(*) filter (length(tok) > 1 and left(tok, 1) <> lower(left(tok, 1)) and substr(tok, 2) = lower(substr(tok, 2))) as title_count from raw group by 1""")
def capitalisation_profile(spark, d):
    return names.capitalisation(_cased(spark, d))


@query(f"""with t as (select source, unnest(regexp_extract_all(text, '{WORD}')) as tok from documents) select lower(tok) as word, min(source) as source, count(*) as n from t where length(tok) >= 3 and left(tok, 1) <> lower(left(tok, 1)) group by 1""")
def gazetteer(spark, d):
    t = read(spark, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(text.PLAIN_WORD), F.lit(0))).alias("tok"))
    return names.gazetteer(t, "source")


@query()
def name_classification(spark, d):
    docs = read(spark, d, "documents")
    spans = tokens.word_spans(docs, "text", "doc_id")
    return names.classify(spans, names.gazetteer(_cased(spark, d).withColumn("o", F.lit(0)), "o", least=9)).select("doc_id", "pos", "tok", "initial", "name_class")


@query()
def address_spans(spark, d):
    return tokens.unchecked_spans(read(spark, d, "documents"), "text", "doc_id")


@query()
def token_sentences(spark, d):
    return tokens.sentence_index(tokens.word_spans(read(spark, d, "conversations"), "text", "conv_id", "turn"), ["conv_id", "turn"]).select("conv_id", "turn", "pos", "tok", "start", "end", "sentence")


# ---------------------------------------------------------------- splits and fuzzy joins


@query(f"""with {SENTS}, cnt as (select p[i] as word, count(*) as count from spot where i > 2 and i < len(p) group by 1), known as (select word from cnt where count >= {FLOOR}),
    s as (select word, count, unnest(range(1, length(word))) as k from cnt where count >= {FLOOR}), c as (select word, count, k, left(word, k) as l, substr(word, k + 1) as r from s),
    f as (select word, any_value(count) as count, arg_min({{'l': l, 'r': r}}, k) as m from c where (length(l) > 1 or l in ('u', 'i')) and (length(r) > 1 or r in ('u', 'i')) and l in (from known) and r in (from known) group by word)
    select word as surface, m.l || ' ' || m.r as split_as, f.count, coalesce(bi.count, 0)::bigint as phrase_count, '' as verdict from f left join bi on bi.w1 = m.l and bi.w2 = m.r""")
def runtogether_splits(spark, d):
    s = sents(spark, d)
    c = s.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("count"))
    return fuzzy.runtogether(c, corpus.ngrams(s, 2, 2), c.where(F.col("count") >= FLOOR).select("word"), FLOOR)


@query(oracles.compound_splits(LEXICON, SAMPLE))
def compound_splits(spark, d):
    c = written(counts(spark, d), "counts")
    return fuzzy.compound_splits(c.select("word"), lexicon(c).select(F.col("surface").alias("word"), "pos"), SAMPLE)


DELETES = "list_distinct([word] || list_transform(range(1, length(word) + 1), lambda i: left(word, i - 1) || substr(word, i + 1)))"


DELETES_TWO = f"list_distinct(flatten(list_transform({DELETES}, lambda z: {DELETES.replace('word', 'z')})))"


@query(f"with {TOKENS}, x as (select word, unnest({DELETES}) as deletion from cnt where count >= {FLOOR}) select deletion, word from x where deletion <> ''")
def delete_index(spark, d):
    return fuzzy.delete_index(counts(spark, d).where(F.col("count") >= FLOOR), 1)


@query(f"""with {TOKENS}, ix as (select deletion, word as cand from (select word, unnest({DELETES}) as deletion from cnt where count >= {FLOOR}) where deletion <> ''), qx as (select word as query, unnest({DELETES}) as deletion from cnt where count < {FLOOR})
    select distinct query, cand from qx join ix using (deletion) where query <> cand""")
def fuzzy_candidates(spark, d):
    c = written(counts(spark, d), "counts")
    return fuzzy.candidates(rare_words(c), fuzzy.delete_index(c.where(F.col("count") >= FLOOR), 1), 1)


@query(f"with {TOKENS}, x as (select word, unnest({DELETES_TWO}) as deletion from cnt where count >= {FLOOR}) select deletion, word from x where deletion <> ''")
def delete_index_two(spark, d):
    """All deletions of up to two characters, as the reference's index has them; delete_index has one."""
    return fuzzy.delete_index(counts(spark, d).where(F.col("count") >= FLOOR), 2)


@query(f"""with {TOKENS}, ix as (select deletion, word as cand from (select word, unnest({DELETES_TWO}) as deletion from cnt where count >= {FLOOR}) where deletion <> ''), qx as (select word as query, unnest({DELETES_TWO}) as deletion from cnt where count < {FLOOR})
    select distinct query, cand from qx join ix using (deletion) where query <> cand and deletion <> ''""")
def fuzzy_candidates_two(spark, d):
    """The pairs of the production join, over the index of up to two deletions; fuzzy_candidates has those of one."""
    c = written(counts(spark, d), "counts")
    return fuzzy.candidates(rare_words(c), fuzzy.delete_index(c.where(F.col("count") >= FLOOR), 2), 2)


@query(f"""with {TOKENS}, x as (select word, count, unnest({DELETES}) as deletion from cnt), pr as (select distinct a.word, b.word as neighbour, b.count as c from x a join x b using (deletion) where a.word <> b.word and b.count >= a.count * 5),
    ok as (select *, case when length(neighbour) < length(word) then 0 when length(neighbour) = length(word) and list_sort(string_split(word, '')) = list_sort(string_split(neighbour, '')) then 1 when length(neighbour) = length(word) then 2 else 3 end as k from pr
        where damerau_levenshtein(translate(word, 'ñï', '12'), translate(neighbour, 'ñï', '12')) = 1 and regexp_full_match(coalesce(array_to_string(list_filter(string_split(neighbour, ''), lambda x: not list_contains(string_split(word, ''), x)), ''), ''), '[a-z]*'))
    select word, arg_min({{'n': neighbour, 'c': c}}, (-c, k, neighbour)).n as neighbour, max(c) as neighbour_count from ok group by word""")
def dominated_types(spark, d):
    return fuzzy.dominant_neighbour(written(counts(spark, d), "counts"))


@query()
def nearest_known(spark, d):
    c = written(counts(spark, d), "counts")
    return fuzzy.nearest_known(rare_words(c), c.where(F.col("count") >= FLOOR), SAMPLE).withColumn("distance", F.round("distance", 3))


@query(f"""with {TOKENS}, s as (select word, unnest(range(1, length(word))) as i from cnt where count < {FLOOR}), m as (select word, i, left(word, i - 1) || substr(word, i + 1, 1) || substr(word, i, 1) || substr(word, i + 2) as swapped from s)
    select word, arg_min(swapped, i) as swapped from m where swapped <> word and swapped in (select word from cnt where count >= {FLOOR}) group by word""")
def swapped_known(spark, d):
    c = written(counts(spark, d), "counts")
    return fuzzy.swapped_known(rare_words(c), c.where(F.col("count") >= FLOOR))


@query(oracles.pool_tally(TOKENS, DELETES, 60, 20, "q", pool.LATIN, SAMPLE))
def pool_admission_tally(spark, d):
    c = written(counts(spark, d), "counts")
    return pool.tally(pool.decide(c, lexicon(c, 60), SAMPLE, floor=20, banned="q"))


# ---------------------------------------------------------------- sounds and forms


@query(oracles.phonotactics(TOKENS, SAMPLE))
def phonotactics(spark, d):
    return counts(spark, d).select("word", phonology.validate(F.col("word"), SAMPLE).alias("v")).select("word", "v.valid", F.concat_ws(";", "v.errors").alias("errors"), F.concat_ws(";", "v.warnings").alias("warnings"))


@query(oracles.transcriptions(TOKENS))
def transcriptions(spark, d):
    return phonetics.transcribe(counts(spark, d).select("word"))


@query()
def syllables(spark, d):
    return phonetics.syllabify(counts(spark, d).select("word"), SAMPLE)


@query(oracles.sandhi_reverse(LEXICON, SAMPLE))
def sandhi_reverse(spark, d):
    c = written(counts(spark, d), "counts")
    return sandhi.reverse(c.select("word"), lexicon(c).select("root"), SAMPLE)


@query(oracles.morph_parses(LEXICON, SAMPLE))
def morph_parses(spark, d):
    c = written(counts(spark, d), "counts")
    p = morphology.parse(c.select("word"), lexicon(c).select(F.col("surface").alias("word"), "pos"), SAMPLE)
    return p.select("word", "status", "root", "root_known", "chain", "score", F.size("alternatives").alias("n_alternatives"))


@query(oracles.complex_words(LEXICON, SAMPLE))
def complex_words(spark, d):
    c = written(counts(spark, d), "counts")
    return morphology.complex_words(c.select("word"), lexicon(c).select(F.col("surface").alias("word"), "pos"), SAMPLE).withColumn("components", F.array_join("components", "+"))


@query()
def spelling_variants(spark, d):
    c = written(counts(spark, d), "counts")
    w = c.select(F.translate("word", "éíóú", "eiou").alias("word")).union(c.select("word"))
    return variants.find(w, lexicon(c), SAMPLE)


@query(oracles.edit_candidates(TOKENS, SAMPLE))
def edit_candidates(spark, d):
    c = counts(spark, d)
    return c.select("word", F.array_join(edits.normalised(F.col("word")), " ").alias("normalised"), F.array_join(edits.banned_repairs(F.col("word"), SAMPLE), " ").alias("repairs"))


# ---------------------------------------------------------------- decisions


@query(oracles.word_votes(LEXICON, SAMPLE))
def word_votes(spark, d):
    r = resources(spark, d)
    v = check.vote(counts(spark, d).select("word"), r)
    return v.withColumn("signals", F.array_join(F.array_sort(F.map_keys("signals")), ","))


@query()
def check_words(spark, d):
    c = written(counts(spark, d), "counts")
    out = check.check(c.select("word"), resources(spark, d, c))
    return out.withColumns({"suggestions": F.array_join(F.col("suggestions.cand"), ","), "signals": F.array_join(F.array_sort(F.map_keys("signals")), ",")})


@query()
def check_text(spark, d):
    docs = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    out = check.check_text(docs, resources(spark, d), "key")
    return out.withColumn("suggestions", F.array_join(F.col("suggestions.cand"), ","))


@query()
def corrected_text(spark, d):
    docs = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return check.correct_text(docs, check.check_text(docs, resources(spark, d), "key"), "key").select("key", "corrected")


@query()
def word_verdicts(spark, d):
    c = written(counts(spark, d), "counts")
    out = analysis.analyse(c.select("word"), resources(spark, d, c))
    return out.withColumns({"components": F.array_join("components", "+"), "offered": F.array_join("offered", ",")})


@query()
def text_corrections(spark, d):
    docs = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return analysis.text_corrections(docs, resources(spark, d), "key", counts=written(counts(spark, d), "counts"))


@query()
def ranked_suggestions(spark, d):
    """The production search, over deletions of up to two characters, for every rare type."""
    c = written(counts(spark, d), "counts")
    freq = c.select("word", frequency.scale(F.col("count")).alias("frequency"))
    return fuzzy.ranked(rare_words(c), c.where(F.col("count") >= FLOOR).select("word"), freq, SAMPLE)


@query(f"with {LEXICON} select surface as word from lexi union select root from lexi")
def content_words(spark, d):
    return analysis.content_words(lexicon(counts(spark, d)))


@query(oracles.welded(TOKENS, FLOOR, SAMPLE))
def welded_words(spark, d):
    return analysis.welded(rare_words(counts(spark, d)), resources(spark, d))


@query(oracles.missing_space(LEXICON, FLOOR))
def missing_space(spark, d):
    c = written(counts(spark, d), "counts")
    pairs = fuzzy.runtogether(c, c.limit(0).select(F.col("word").alias("w1"), F.col("word").alias("w2"), "count"), c.where(F.col("count") >= FLOOR).select("word"), FLOOR)
    glued = lexicon(c).select(F.concat("surface", "root").alias("word")).distinct()
    return analysis.missing_space(glued.union(c.select("word")).distinct(), pairs, c)


def _spans(spark, d) -> DataFrame:
    t = read(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text")
    return tokens.sentence_index(tokens.word_spans(t, "text", "key"), ["key"])


@query()
def realword_flags(spark, d):
    b = grams.blocks(corpus.lines(read(spark, d, "documents")).distinct())
    m, c = grams.model(b), written(grams.word_counts(b), "counts")
    return context.corpus_realword(_spans(spark, d), lexicon(c), c, m, "key", "abcdefghijklmnopqrstuvwxyz")


@query()
def context_rerank(spark, d):
    c, s = written(counts(spark, d), "counts"), written(sents(spark, d), "sents")
    spans = _spans(spark, d).withColumn("plain", F.translate(text.unaccented(F.lower("tok")), "'", ""))
    spans = context.with_context(spans, ["key"])
    sets = context.confusion_sets(spans.select(F.lower("tok").alias("word")), lexicon(c), c, "abcdefghijklmnopqrstuvwxyz", 5)
    offered = sets.groupBy("word").agg(F.collect_list(F.struct(F.col("n").alias("rank"), F.col("alternative").alias("cand"), F.lit("levenshtein_primary").alias("method"))).alias("cands"))
    flags = spans.select(F.concat_ws("@", "key", "pos").alias("flag"), F.lower("tok").alias("word"), "l2", "l1", "r1", "r2").join(offered, "word").drop("word")
    return context.rerank_groups(flags, *model(s)).select("flag", "cand", "rank", "new_rank")


# ---------------------------------------------------------------- vectors


@query("""with v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings), q as (select * from v where vec_id % 100 = 0),
    p as (select q.vec_id as query, v.vec_id as neighbour, round(list_cosine_similarity(q.e, v.e), 6) as similarity from q join v on q.vec_id <> v.vec_id)
    select query, row_number() over (partition by query order by similarity desc, neighbour)::int as rank, neighbour, similarity from p qualify rank <= 5""")
def embedding_top_neighbours(spark, d):
    v = read(spark, d, "embeddings")
    return vectors.top_neighbours(v.where("vec_id % 100 = 0"), v)


@query("""with v as (select label, list_transform(embedding, lambda x: x / sqrt(list_dot_product(embedding::double[], embedding::double[]))) as u from embeddings),
    m as (select label, k, avg(u[k]) as m from (select label, u, unnest(range(1, len(u) + 1)) as k from v) group by 1, 2), n as (select label, sqrt(sum(m * m)) as n from m group by 1)
    select label, (k - 1)::int as dim, round(m / n, 4) as value from m join n using (label)""")
def embedding_centroids(spark, d):
    return vectors.centroids(read(spark, d, "embeddings"), "label").select("label", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 4))


@query("""with v as (select vec_id, label, embedding::double[] as e from embeddings), u as (select label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v), m as (select label, k, avg(u[k]) as m from (select label, u, unnest(range(1, len(u) + 1)) as k from u) group by 1, 2),
    c as (select label, list(m order by k) as c from m group by 1) select vec_id, round(list_cosine_similarity(e, c), 6) as fit from v join c using (label)""")
def centroid_fit(spark, d):
    v = read(spark, d, "embeddings")
    c = vectors.centroids(v, "label")
    return v.join(c, "label").select("vec_id", F.round(vectors.fit(F.col("embedding"), F.col("centroid")), 6).alias("fit"))


# ---------------------------------------------------------------- lexicon


@query(f"""with {LEXICON} select count(*) as entries, count(distinct surface) as surfaces, count(distinct root) as roots, count(*) filter (count < {2 * FLOOR}) as needs_review, count(*) filter (contains(surface, ' ')) as phrases,
    count(*) filter (surface = root) as bare, count(distinct pos) as classes from lexi""")
def lexicon_stats(spark, d):
    return lex.stats(lexicon(counts(spark, d)))


@query("""with s as (select c_custkey as k, c_name as name, c_acctbal as bal from customer where c_custkey % 3 <> 0), t as (select c_custkey as k, upper(c_name) as name, 0.0 as bal from customer where c_custkey % 2 = 0)
    select coalesce(t.k, s.k) as k, coalesce(t.name, s.name) as name, (case when t.k is null then s.bal else t.bal end)::double as bal from s full join t on s.k = t.k""")
def lexicon_upsert(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("double").alias("bal"))
    return lex.upsert(c.where("k % 3 <> 0"), c.where("k % 2 = 0").select("k", F.upper("name").alias("name"), F.lit(0.0).alias("bal")), "k")


@query("select c_custkey as k, c_name as name from customer where c_custkey % 3 <> 0 and not exists (select 1 from orders where o_custkey = c_custkey)")
def lexicon_orphans(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")).where("k % 3 <> 0")
    return lex.orphans(c, read(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(f"""with {TOKENS}, w as (select word from cnt where count >= {FLOOR}), known as (select word, true as k from w), t as (select conv_id, turn, unnest(list_transform(regexp_extract_all(text, '{WORD}'), lambda x: lower(x))) as word from conversations),
    v as (select conv_id, turn, case when k then 'valid' when regexp_matches(word, 'x') then 'invalid' else 'unknown' end as verdict from t left join known using (word))
    select conv_id, turn, count(*) as n, case when bool_or(verdict = 'invalid') then 'has_errors' when bool_or(verdict = 'unknown') then 'has_unknown' else 'all_valid' end as verdict from v group by 1, 2""")
def phrase_verdicts(spark, d):
    c = counts(spark, d).where(F.col("count") >= FLOOR).select("word", F.lit("valid").alias("verdict"))
    t = read(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("key"), F.explode(corpus.words(F.col("text"))).alias("word"))
    bad = t.select("word").distinct().join(c, "word", "left_anti").where("contains(word, 'x')").select("word", F.lit("invalid").alias("verdict"))
    return morphology.phrase_verdicts(t, c.union(bad), "key").select("key.conv_id", "key.turn", "n", "verdict")


@query(f"with {LEXICON}, f as (select surface as form, root from lexi), r as (select surface as word, root from lexi union select root, root from lexi) select word, array_to_string(list_sort(list(distinct form)), ',') as forms from r join f using (root) group by word")
def word_forms(spark, d):
    e = written(lexicon(counts(spark, d)), "lexicon")
    asked = e.select(F.col("surface").alias("word")).union(e.select("root"))
    return lex.word_forms(asked, e).withColumn("forms", F.array_join("forms", ","))


@query(f"with {LEXICON} select count(distinct w) as words from (select surface as w from lexi union all select root from lexi)")
def vocabulary_size(spark, d):
    return lex.vocabulary_size(lex.surface_forms(lexicon(counts(spark, d))))


@query(oracles.lexicon_repair(LEXICON, SAMPLE))
def lexicon_repair(spark, d):
    c = written(counts(spark, d), "counts")
    base = lexicon(c).withColumn("surface", F.when(F.length("surface") % 5 == 0, F.concat("surface", F.lit("-"))).when(F.length("surface") % 7 == 0, F.concat("surface", F.lit(" (n.)"))).otherwise(F.col("surface")))
    return repair.outcomes(base, profile=SAMPLE).groupBy("outcome", "rule").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- evaluation and service


@query("""with r as (select l.quality = 0 as e, regexp_matches(d.text, '[#*$%&|<>]') as f, d.lang from labels l join documents d using (doc_id) where d.text is not null),
    g as (select lang, count(*) filter (e and f) as tp, count(*) filter (e and not f) as fn, count(*) filter (not e and f) as fp, count(*) filter (not e and not f) as tn from r group by lang)
    select lang, tp, fn, fp, tn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as precision, round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 6) as f1,
    round(case when tn + fp > 0 then tn / (tn + fp) else 0 end, 6) as specificity, round(case when tp + fn + fp + tn > 0 then (tp + tn) / (tp + fn + fp + tn) else 0 end, 6) as accuracy from g""")
def detection_metrics(spark, d):
    r = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").where("text is not null").select((F.col("quality") == 0).alias("is_error"), F.col("text").rlike("[#*$%&|<>]").alias("flagged"), "lang")
    return metrics.detection(r, "lang")


RANKS = "select lang as kind, case when n_chars % 14 < 12 then n_chars % 14 + 1 end as rank from documents"
TOPS = ", ".join(f"round(avg(case when r <= {k} then 1.0 else 0.0 end), 6) as top{k}" for k in (1, 3, 5, 10))


@query(f"""with t as ({RANKS}), x as (select kind, case when rank <= 10 then rank end as r from t) select kind, count(*) as items, {TOPS}, round(avg(coalesce(1.0 / r, 0.0)), 6) as mrr, count(*) filter (r is null) as never from x group by kind
    union all select null, count(*), {TOPS}, round(avg(coalesce(1.0 / r, 0.0)), 6), count(*) filter (r is null) from x""")
def correction_metrics(spark, d):
    r = read(spark, d, "documents").select(F.col("lang").alias("kind"), F.expr("case when n_chars % 14 < 12 then n_chars % 14 + 1 end").alias("rank"))
    return metrics.by_kind(r)


@query(f"""with {LINES}, t as (select md5, unnest(regexp_extract_all(line, '{WORD}')) as tok from uniq), s as (select md5, count(*) as n, count(*) filter (length(tok) > 9) as f from t group by 1)
    select sum(n)::bigint as tokens, sum(f)::bigint as flagged, round(sum(f) / sum(n), 6) as token_rate, round(count(*) filter (f > 0) / count(*), 6) as sentence_rate from s""")
def running_text_rates(spark, d):
    t = unique_lines(spark, d).select(F.col("md5").alias("sentence"), F.explode(F.regexp_extract_all("line", F.lit(text.PLAIN_WORD), F.lit(0))).alias("tok"))
    return metrics.running_text(t.withColumn("flagged", F.length("tok") > 9))


@query(oracles.SIGN_TEST)
def sign_test(spark, d):
    docs = read(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("item"), (F.col("n_chars") % 3 == 0).alias("right"))
    b = docs.select(F.col("doc_id").alias("item"), (F.col("n_chars") % 5 < 2).alias("right"))
    return metrics.sign_test(metrics.paired(a, b))


@query("""with r as (select quality = 0 as e, toxic = 0 as good, n_chars % 17 as gain from labels join documents using (doc_id)), m as (select unnest([6.0, 7.0, 8.0, 10.0]) as margin),
    g as (select margin, count(*) filter (not e and gain >= margin) as false_flags, count(*) filter (not e) as clean, count(*) filter (e and gain >= margin and good) as caught, count(*) filter (e) as errors, count(*) filter (gain >= margin) as flags from r cross join m group by margin)
    select margin::double as margin, false_flags, round(case when clean > 0 then false_flags / clean else 0 end, 6) as false_rate, round(case when errors > 0 then caught / errors else 0 end, 6) as recall, round(case when flags > 0 then caught / flags else 0 end, 6) as precision from g""")
def margin_sweep(spark, d):
    r = read(spark, d, "labels").join(read(spark, d, "documents"), "doc_id").select((F.col("quality") == 0).alias("is_error"), (F.col("toxic") == 0).alias("right"), (F.col("n_chars") % 17).alias("gain"))
    return metrics.margin_sweep(r, [6.0, 7.0, 8.0, 10.0])


LIMITS = ((2, 86400), (5, 7 * 86400))


@query(oracles.rate_limits(LIMITS))
def rate_limit_decisions(spark, d):
    e = read(spark, d, "events").select("event_id", F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("ts"))
    return limits.replay(e, LIMITS)
