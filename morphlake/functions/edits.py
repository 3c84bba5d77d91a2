"""Edit candidates as array expressions, and the two edit distances as Arrow functions over distinct pairs."""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from morphlake.profile import LanguageProfile

CAP = 4
CONSONANT = "[^aáeéiíoóuúyýï]"


def deletes(c: Column, k: int = 2) -> Column:
    """All strings that up to k deletions leave, the word included; empty ones dropped."""
    out = F.array(c)
    for _ in range(k):
        one = F.flatten(F.transform(out, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))))
        out = F.array_distinct(F.concat(out, one))
    return F.filter(out, lambda w: w != "")


def edits1(c: Column, alphabet: str) -> Column:
    """All strings one deletion, swap, replacement or insertion away, without the word."""
    letters = F.split(F.lit(alphabet), "")
    n = F.length(c)
    left = lambda i: F.substr(c, F.lit(1), i)  # noqa: E731  the first i characters
    right = lambda i: F.substr(c, i + 1)  # noqa: E731  those after them
    places = F.sequence(F.lit(0), n)
    inner = F.filter(places, lambda i: i < n)
    drop = F.transform(inner, lambda i: F.concat(left(i), right(i + 1)))
    swap = F.transform(F.filter(places, lambda i: i < n - 1), lambda i: F.concat(left(i), F.substr(c, i + 2, F.lit(1)), F.substr(c, i + 1, F.lit(1)), right(i + 2)))
    put = F.flatten(F.transform(inner, lambda i: F.transform(letters, lambda x: F.concat(left(i), x, right(i + 1)))))
    add = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda x: F.concat(left(i), x, right(i)))))
    return F.array_except(F.array_distinct(F.concat(drop, swap, put, add)), F.array(c, F.lit("")))


def normalised(c: Column) -> Column:
    """Orthographic rewrites to try before any search: doubled consonants, final ng / n / gn / g, ie and ei."""
    w = F.lower(c)
    cut = lambda k: F.substr(w, F.lit(1), F.length(w) - k)
    once = lambda a, b: F.regexp_replace(w, f"^((?:(?!{a}).)*){a}", f"$1{b}")  # noqa: E731  the first occurrence only
    tried = F.array(
        F.regexp_replace(w, f"({CONSONANT})\\1+", "$1"),
        F.when(w.endswith("ng") & ~w.endswith("ang"), F.concat(cut(2), F.lit("n"))),
        F.when(w.endswith("n"), F.concat(w, F.lit("g"))),
        F.when(w.endswith("gn"), F.concat(cut(2), F.lit("ng"))),
        F.when(w.endswith("g") & ~w.endswith("ng"), F.concat(cut(1), F.lit("ng"))),
        F.when(w.contains("ie"), once("ie", "i")), F.when(w.contains("ie"), once("ie", "e")),
        F.when(w.contains("ei"), once("ei", "ie")),
        F.when(~w.contains("ie"), F.regexp_replace(w, f"(?<={CONSONANT})e(?={CONSONANT})", "ie")),
    )
    return F.array_distinct(F.filter(tried, lambda x: x.isNotNull() & (x != w) & (F.length(x) >= 2)))


def banned_repairs(c: Column, profile: LanguageProfile, most: int = 12) -> Column:
    """Words with one banned letter replaced (or all of a banned pair), sorted, the first `most`."""
    pairs = [F.when(c.contains(a), F.replace(c, F.lit(a), F.lit(b))) for a, b in profile.banned_pairs]
    table = F.create_map(*[x for k, v in profile.banned.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.element_at(table, F.substr(c, i, F.lit(1))).isNotNull())
    single = F.flatten(F.transform(at, lambda i: F.transform(F.element_at(table, F.substr(c, i, F.lit(1))), lambda r: F.concat(F.substr(c, F.lit(1), i - 1), r, F.substr(c, i + 1)))))
    found = F.concat(F.array(*pairs), single) if pairs else single
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull() & (x != "") & (x != c)))), 1, most)


# ---------------------------------------------------------------- distances


def osa(a: str, b: str, cap: int = CAP) -> float:
    """Restricted Damerau distance: no substring is edited twice. Lengths further apart than cap give cap + 1."""
    return float(_osa_all([a], [b], cap)[0])


def _table(left: list, right: list, cost: np.ndarray | None, swaps: bool) -> np.ndarray:
    """Distances of pairs of number sequences, all pairs a cell at a time: one table for all of them."""
    n, la, lb = len(left), np.array([len(x) for x in left]), np.array([len(x) for x in right])
    rows, columns = int(la.max()), int(lb.max())
    a, b = np.full((rows + 1, n), -1), np.full((columns + 1, n), -2)
    for table, given, sizes in ((a, left, la), (b, right, lb)):
        flat = np.array([x for own in given for x in own], np.int64)
        row = np.repeat(np.arange(n), sizes)
        table[1 + np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
    out = np.where(la == 0, lb, np.where(lb == 0, la, 0)).astype(np.float64)
    before, above = None, np.repeat(np.arange(columns + 1, dtype=np.float64)[:, None], n, axis=1)
    for i in range(1, rows + 1):
        row = np.empty_like(above)
        row[0] = i
        for j in range(1, columns + 1):
            step = (a[i] != b[j]).astype(np.float64) if cost is None else cost[a[i], b[j]]
            row[j] = np.minimum(np.minimum(above[j], row[j - 1]) + 1.0, above[j - 1] + step)
            if swaps and i > 1 and j > 1:
                turned = (a[i] == b[j - 1]) & (a[i - 1] == b[j])
                row[j] = np.where(turned, np.minimum(row[j], before[j - 2] + 1.0), row[j])
        here = np.flatnonzero((la == i) & (lb > 0))
        out[here] = row[lb[here], here]
        before, above = above, row
    return out


def _by_length(left: list, right: list, run) -> np.ndarray:
    """run over the pairs of about one length together, so that short words don't pay for a long one."""
    longest = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)])
    out = np.empty(len(left))
    for k in np.unique((longest + 3) // 4).tolist():
        at = np.flatnonzero((longest + 3) // 4 == k)
        for c in range(0, len(at), 8192):
            own = at[c : c + 8192]
            out[own] = run([left[i] for i in own.tolist()], [right[i] for i in own.tolist()])
    return out


def _osa_all(a: list[str], b: list[str], cap: int) -> np.ndarray:
    far = np.array([abs(len(x) - len(y)) > cap for x, y in zip(a, b, strict=True)])
    out = np.full(len(a), cap + 1.0)
    near = np.flatnonzero(~far)
    if len(near):
        points = lambda w: list(map(ord, w))
        out[near] = _by_length([points(a[i]) for i in near.tolist()], [points(b[i]) for i in near.tolist()], lambda x, y: _table(x, y, None, True))
    return out


class PhonemeDistance:
    """Weighted distance over units; the smaller of it and the character distance is the words' distance."""

    def __init__(self, profile: LanguageProfile):
        self.cost = dict(profile.confusions)
        self.unit = re.compile("(?s)" + "|".join([*map(re.escape, sorted(profile.digraphs, key=len, reverse=True)), "."]))
        self.units = lru_cache(200_000)(lambda w: tuple(self.unit.findall(w.lower())))

    def phonemic_all(self, a: list[str], b: list[str]) -> np.ndarray:
        x, y = [self.units(w) for w in a], [self.units(w) for w in b]
        number = {u: k for k, u in enumerate(dict.fromkeys(u for own in (*x, *y) for u in own))}
        cost = np.ones((len(number) + 2, len(number) + 2))  # two more for the padding of either side
        np.fill_diagonal(cost, 0.0)
        for (u, v), c in self.cost.items():
            if u in number and v in number:
                cost[number[u], number[v]] = c
        return _by_length([[number[u] for u in own] for own in x], [[number[u] for u in own] for own in y], lambda p, q: _table(p, q, cost, False))

    def all(self, a: list[str], b: list[str]) -> np.ndarray:
        """The distances of many pairs."""
        if not a:
            return np.zeros(0)
        out = np.minimum(self.phonemic_all(a, b), _osa_all(a, b, CAP))
        return np.where([x == y for x, y in zip(a, b, strict=True)], 0.0, out)

    def phonemic(self, a: str, b: str) -> float:
        return float(self.phonemic_all([a], [b])[0])

    def __call__(self, a: str, b: str) -> float:
        return float(self.all([a], [b])[0])

    def explain(self, a: str, b: str) -> list[dict]:
        """The edits of the view that gives the distance; their costs add up to it.

        The cheapest way to every pair of prefixes keeps its last edit, of equally cheap ones the first of: a swap, a
        replacement, a drop, an addition.
        """
        if a == b:
            return []
        sounds = self.phonemic(a, b) <= osa(a, b)
        x, y = (self.units(a), self.units(b)) if sounds else (tuple(a), tuple(b))
        ways: dict[tuple[int, int], tuple[float, tuple[int, int] | None, dict | None]] = {(0, 0): (0.0, None, None)}

        def edit(op: str, i: int, j: int, di: int, dj: int) -> dict:
            u, v = x[i - di : i], y[j - dj : j]
            known = op == "substitute" and (u[0], v[0]) in self.cost
            return {"op": op, "from": "".join(u), "to": "".join(v), "cost": self.cost[u[0], v[0]] if known and sounds else 1.0, "known": known}

        for i, j in itertools.product(range(len(x) + 1), range(len(y) + 1)):
            steps = []
            if not sounds and min(i, j) > 1 and (x[i - 2], x[i - 1]) == (y[j - 1], y[j - 2]) and x[i - 1] != y[j - 1]:
                steps.append((2, 2, edit("swap", i, j, 2, 2)))
            if i and j:
                steps.append((1, 1, None if x[i - 1] == y[j - 1] else edit("substitute", i, j, 1, 1)))
            if i:
                steps.append((1, 0, edit("drop", i, j, 1, 0)))
            if j:
                steps.append((0, 1, edit("add", i, j, 0, 1)))
            if steps:
                reach = [(round(ways[i - di, j - dj][0] + (e["cost"] if e else 0.0), 9), (i - di, j - dj), e) for di, dj, e in steps]
                ways[i, j] = min(reach, key=lambda w: w[0])
        out, at = [], (len(x), len(y))
        while at is not None:
            _, at, e = ways[at]
            out += [e] if e else []
        return out[::-1]


def distance_udf(profile: LanguageProfile):
    """An Arrow function (a, b) -> distance rounded to six places; a batch of pairs is one run over NumPy tables."""

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        out[there] = np.round(PhonemeDistance(profile).all(a[there].tolist(), b[there].tolist()), 6)
        return pd.Series(out, dtype="Float64").mask(~there)

    return distance


def osa_udf(cap: int = CAP):
    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        there = (a.notna() & b.notna()).to_numpy()
        out = np.full(len(a), np.nan)
        if there.any():
            out[there] = _osa_all(a[there].tolist(), b[there].tolist(), cap)
        return pd.Series(out, dtype="Float64").mask(~there)

    return distance


def explain_udf(profile: LanguageProfile):
    @F.pandas_udf("array<struct<op:string,from:string,to:string,cost:double,known:boolean>>")
    def explain(a: pd.Series, b: pd.Series) -> pd.Series:
        d = PhonemeDistance(profile)
        return pd.Series([d.explain(x, y) for x, y in zip(a, b, strict=True)])

    return explain
