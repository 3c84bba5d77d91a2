"""Language ID by bit-sliced Bloom filters of n-grams: one slot holds a bit for every language.

Fitting takes the texts of at most `per_language` labelled rows of each language (the documented bound; those with the
least hash of their id), finds the distinct n-grams of each (code points, lower-cased, white space folded) and, for the
n-grams that at least `floor` of the sampled rows of that language hold, sets the language's bit in `hashes` slots. A
lookup is the AND of the slots: a bitmask of all languages that hold the n-gram, in as many words of 64 bits as it takes. A text's counts by language are popcounts
over the masks of its n-grams, corrected for the share of false positives that each filter's fill implies; n-grams that
every language holds say nothing and drop out. The language with the highest corrected count wins, ties by its name.

Whole texts are read. `und` with score 0 stands for null texts and texts without a letter; a text with a letter but
without a known n-gram gets the most frequent label with score 0. lang, source and id never enter a prediction. Without
a labelled row every text is `und`. Repeated rows are predicted each, rows of one id in the sample rank by it in any order;
more columns, whatever their names, are not read. The driver holds the n-grams of the sampled rows only: `per_language` texts
of each language, those below `floor` left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, frugal, mix

PER_LANGUAGE = 1500
SIZES = (2, 3, 4, 5)
SLOTS = 1 << 21
HASHES = 2
FLOOR = 3
UND = "und"
WORD = 64  # languages in a mask word


def code_points(text: str) -> np.ndarray:
    """Code points of the text, lower-cased, white space runs as one space, a space at both ends."""
    folded = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(folded.encode("utf-32-le", "replace"), np.uint32)


def gram_hashes(points: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of the sizes in SIZES; runs of digits or marks alone are not left out."""
    p = points.astype(np.uint64) + np.uint64(1)
    out, h = [], p
    for n in range(2, max(SIZES) + 1):
        if len(p) < n:
            break
        h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + p[n - 1 :]
        if n in SIZES:
            out.append(mix(h ^ np.uint64(n << 56)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Model:
    """The slots (a bit for each language), the languages' names and false-positive rates."""

    def __init__(self, names: list[str], grams: list[np.ndarray], slots: int = SLOTS, hashes: int = HASHES, default: str | None = None):
        self.names, self.slots, self.hashes = names, slots, hashes
        self.default = default or (names[0] if names else UND)
        kind = np.uint8 if len(names) <= 8 else np.uint16 if len(names) <= 16 else np.uint32 if len(names) <= 32 else np.uint64
        self.tables = [np.zeros(slots, kind) for _ in range(max(1, -(-len(names) // WORD)))]
        for i, own in enumerate(grams):
            for k in range(hashes):
                np.bitwise_or.at(self.tables[i // WORD], self._slot(own, k), kind(1 << i % WORD))
        self.kind = kind
        self.false = np.array([((self.tables[i // WORD] >> kind(i % WORD)) & kind(1)).mean() ** hashes for i in range(len(names))])

    def _slot(self, h: np.ndarray, k: int) -> np.ndarray:
        return ((h if k == 0 else mix(h + np.uint64(k))) & np.uint64(self.slots - 1)).astype(np.int64)

    def masks(self, h: np.ndarray, word: int = 0) -> np.ndarray:
        """The bitmask of the languages that hold each n-gram (or seem to): this word of it."""
        out = self.tables[word][self._slot(h, 0)]
        for k in range(1, self.hashes):
            some = np.flatnonzero(out)
            out[some] &= self.tables[word][self._slot(h[some], k)]
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names or not any(map(str.isalpha, text)):
            return UND, 0.0
        h = gram_hashes(code_points(text))
        n, langs = len(h), len(self.names)
        if langs <= 8:
            masks = self.masks(h)
            tally = np.bincount(masks, minlength=1 << langs)
            which = np.arange(len(tally))
            tally[-1 if langs > 1 else 0] = 0  # all languages: says nothing
            counts = np.array([tally[(which >> bit) & 1 == 1].sum() for bit in range(langs)])
        else:
            words = [self.masks(h, w) for w in range(len(self.tables))]
            some = np.zeros(n, bool)  # not all languages
            for w, masks in enumerate(words):
                some |= masks != self.kind((1 << min(WORD, langs - w * WORD)) - 1)
            words = [masks[some] for masks in words]
            counts = np.array([((words[i // WORD] >> self.kind(i % WORD)) & self.kind(1)).sum() for i in range(langs)])
        right = np.maximum((counts - n * self.false) / (1 - np.minimum(self.false, 0.999)), 0.0)
        total = right.sum()
        if total <= 0:
            return self.default, 0.0
        best = max(range(langs), key=lambda b: (right[b], [-ord(c) for c in self.names[b]]))
        return self.names[best], float(right[best] / total)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, floor: int = FLOOR, slots: int = SLOTS, hashes: int = HASHES) -> Model:
    """The model of labelled rows with a text and a language; at most per_language rows of each are read."""
    from pyspark.sql import Window

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").collect()}  # a row for each language
    if not counts:
        return Model([], [])
    # the least hashes of each language: a threshold a little above the bound's share leaves few rows to rank
    h = F.xxhash64(F.col("id").cast("string"), F.lit("sample"))
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2.0 * per_language / n + 50.0 / n)))]), F.col("lang"))
    near = rows.where(F.col("lang").isin(list(counts))).withColumn("h", h).where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    few = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "id"))).where(F.col("rank") <= per_language)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = np.unique(gram_hashes(code_points(text)))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array(own.view(np.int64))], names=["lang", "gram"])

    names = sorted(counts)
    found = few.select("lang", "text").mapInArrow(grams, "lang string, gram long").groupBy("lang", "gram").agg(F.count("*").alias("n"))
    # an n-gram must stand in `floor` rows, or in all where there are fewer
    least = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(floor, max(1, n // 3))))]), F.col("lang"))
    kept = found.where(F.col("n") >= least).select("lang", "gram")
    table = kept.toArrow() if hasattr(kept, "toArrow") else pa.Table.from_pandas(kept.toPandas())  # bounded: the sampled rows' n-grams
    langs, values = np.array(table.column("lang").to_pylist(), object), table.column("gram").to_numpy().view(np.uint64)
    return Model(names, [values[langs == k] for k in names], slots, hashes, max(names, key=lambda k: (counts[k], k)))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language and its score (0 to 1) as the last two columns."""
    names = docs.columns
    where = names.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # slots and names: of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = [m.predict(t) for t in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[*b.schema.names, lang, score])

    from pyspark.sql import types as T

    return docs.mapInArrow(frugal(run), T.StructType([*docs.schema.fields, T.StructField(lang, T.StringType()), T.StructField(score, T.DoubleType())]))


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): a model of the rows that are not held out, over all rows."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    light = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(light, model).select(F.col("id").alias(id_col), "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that no language fits (`und`: null texts and texts without a letter)."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    lang = free_name(docs, "lang_pred")
    score = free_name(docs, "score")
    return predict(docs, model, text_col, lang, score).where(F.col(lang) != UND).drop(lang, score)
