"""A language as data: alphabet, sound patterns, affixes, sandhi and confusion costs.

Every operator takes a LanguageProfile. `SAMPLE` is an invented profile for Latin-script prose that the driver's queries and
the tests use; a real language brings its own values, as Python values or read from tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Affix:
    form: str
    function: str = ""
    applies_to: tuple[str, ...] = ()
    hosts: tuple[str, ...] = ()
    variants: tuple[str, ...] = ()
    productive: bool = True
    result_pos: str = ""


@dataclass(frozen=True)
class SandhiRule:
    id: str
    trigger: str
    initials: str
    surface: str
    exceptions: tuple[str, ...] = ()
    kind: str = "initial"  # initial: the root opens with one of `initials`; geminate: the rest opens with `initials`; never: recorded only


@dataclass(frozen=True)
class LanguageProfile:
    name: str
    vowels: str
    letters: str
    digraphs: tuple[str, ...]
    clusters: tuple[str, ...] = ()
    aspirates: tuple[str, ...] = ()
    codas: tuple[str, ...] = ()
    extra_codas: tuple[str, ...] = ("h", "w")
    loan_finals: tuple[str, ...] = ()
    geminates: tuple[str, ...] = ()
    no_final_vowels: str = ""
    exceptions: tuple[str, ...] = ()
    invalid_alone: tuple[str, ...] = ()
    prefixes: tuple[Affix, ...] = ()
    suffixes: tuple[Affix, ...] = ()
    infixes: tuple[Affix, ...] = ()
    clitics: tuple[str, ...] = ()
    free_morphemes: tuple[str, ...] = ()
    interfixes_a: tuple[str, ...] = ()
    interfixes_b: tuple[str, ...] = ()
    sandhi: tuple[SandhiRule, ...] = ()
    confusions: dict[tuple[str, str], float] = field(default_factory=dict)
    banned: dict[str, tuple[str, ...]] = field(default_factory=dict)
    banned_pairs: tuple[tuple[str, str], ...] = ()
    closed_roots: tuple[str, ...] = ()

    def prefix_rows(self, spark: SparkSession) -> DataFrame:
        """The productive prefixes, longest first (priority 0)."""
        own = sorted((p for p in self.prefixes if p.productive), key=lambda p: (-len(p.form), p.form))
        return spark.createDataFrame([(i, p.form, p.function, list(p.applies_to)) for i, p in enumerate(own)], "priority int, prefix string, prefix_function string, prefix_applies array<string>")

    def suffix_rows(self, spark: SparkSession) -> DataFrame:
        own = sorted(((v, s) for s in self.suffixes for v in (s.form, *s.variants)), key=lambda x: (-len(x[0]), x[0]))
        return spark.createDataFrame([(i, v, s.function, list(s.applies_to), list(s.hosts)) for i, (v, s) in enumerate(own)], "priority int, suffix string, suffix_function string, suffix_applies array<string>, hosts array<string>")

    def sandhi_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, r.id, r.trigger, r.initials, r.surface, list(r.exceptions), r.kind) for i, r in enumerate(self.sandhi)], "rule int, rule_id string, trigger string, initials string, surface string, exceptions array<string>, kind string")


# The ten digraphs, the confusion costs and the repairs of banned letters that edit distances are defined by.
DIGRAPHS = ("ng", "sh", "ph", "th", "kh", "bh", "dh", "jh", "lh", "rh")
_PAIRS = {
    ("ng", "g"): 0.4, ("ng", "n"): 0.4, ("a", "á"): 0.3, ("e", "é"): 0.3, ("i", "í"): 0.3, ("o", "ó"): 0.3, ("u", "ú"): 0.3, ("y", "ý"): 0.3,
    ("d", "t"): 0.8, ("b", "p"): 0.8, ("k", "g"): 0.7, ("n", "m"): 0.7, ("i", "ï"): 0.3, ("n", "ñ"): 0.3,
}
CONFUSIONS = {pair: cost for (a, b), cost in _PAIRS.items() for pair in ((a, b), (b, a))}
BANNED = {"f": ("ph", "p", ""), "v": ("b", "w", ""), "z": ("s", "j", ""), "c": ("k", "s", ""), "x": ("ks", "k", ""), "q": ("k", "")}
BANNED_PAIRS = (("fii", "ñi"), ("fi", "ñ"))

SAMPLE = LanguageProfile(
    name="sample",
    vowels="aáeéiíoóuúyýïèêëàâîôûùäöü",
    letters="abcdefghijklmnopqrstuvwxyzáéíóúýïñèêëàâîôûùäöüßç'-",
    digraphs=DIGRAPHS,
    clusters=("bl", "br", "cl", "cr", "dr", "fl", "fr", "gl", "gr", "pl", "pr", "sc", "sk", "sl", "sm", "sn", "sp", "st", "sw", "tr", "tw", "wh", "ch", "nd", "nt", "ly", "shr", "thr"),
    aspirates=("kh", "bh", "dh", "jh", "lh", "rh"),
    codas=("p", "b", "d", "t", "k", "m", "n", "r", "j", "s", "l", "f", "g", "c", "ng", "sh", "th", "ph", "ñ"),
    loan_finals=("x", "z"),
    geminates=("ss", "ll", "tt", "nd", "nt", "st", "rs", "rd", "rt", "wh", "ch", "ns", "ts", "ds", "es"),
    no_final_vowels="y",
    exceptions=("hm", "mr"),
    invalid_alone=("ng", "sh"),
    prefixes=(
        Affix("re", "iterative", ("verb", "noun")), Affix("un", "negative", ("adjective",)), Affix("in", "locative"), Affix("an", "nominal", ("verb", "noun"), result_pos="noun"),
        Affix("th", "deictic"), Affix("over", "excessive", ("verb",)), Affix("de", "reversive"),
    ),
    suffixes=(Affix("ing", "progressive", ("verb", "noun")), Affix("ed", "past"), Affix("ly", "manner", ("adjective", "noun")), Affix("er", "agent", variants=("or",)), Affix("tion", "nominal")),
    infixes=(Affix("er", "intensive"),),
    clitics=("the", "a"), free_morphemes=("to", "of"), interfixes_a=("and",), interfixes_b=("or",),
    sandhi=(SandhiRule("n_to_l", "in", "l", "il", ("inlet",), "geminate"), SandhiRule("n_to_m", "in", "bmp", "im"), SandhiRule("n_to_r", "in", "r", "ir", (), "geminate"), SandhiRule("old", "an", "k", "ang", (), "never")),
    confusions=CONFUSIONS, banned=BANNED, banned_pairs=BANNED_PAIRS, closed_roots=("the", "of", "to", "and"),
)
