"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

The pieces, scores and byte pieces come from a public SentencePiece model. A text becomes units (spaces and what follows
up to the next space; no piece crosses that), a unit its characters, and an agenda merges the pair with the best score,
the leftmost first. Dropout: a candidate that comes up is skipped when a keyed hash of (seed, document id, unit, number of
the unit in the text, place, length) falls below the rate, so a seed fixes every segmentation, on any machine and in any
order, and every occurrence of a unit draws anew, within a text as over texts. A bounded memo holds no draws: it has
each unit's undropped merges, against which an occurrence's hashes are held; the occurrences in which one of them is
dropped are segmented anew, many side by side (whether a candidate is dropped depends on its hash alone, so an agenda
that passes dropped candidates over gives what one that never had them gives). Characters without a
piece fall back to bytes; so does a literal U+2581, which keeps decoding lossless.

Null and empty texts have no ids. Any text of any length decodes to itself (it is read some
thousand units at a time). Repeated rows are encoded each; an empty table
gives no rows; more columns are not read. At rate 0 the ids equal the library's.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

RATE = 0.1
SEED = 1
MEMO = 400_000  # units remembered in a worker
UNITS = 50_000  # occurrences handled at once
BLOCK = 8192  # units whose agendas advance together
MEMO_UNIT = 48  # characters of the longest remembered unit
SPACE = "▁"
_UNIT = re.compile(" *[^ ]+| +")
_M = (1 << 64) - 1


def _drawn(base: int, candidate: int) -> int:
    h = base ^ candidate
    h = ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _M
    return ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & _M


class Model:
    """Pieces of a SentencePiece BPE model: ranks for merging, ids, bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_id, self.id, self.score, self.raw = [0] * 256, {}, {}, [b""] * n
        self._pairs: _Pairs | None = None
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id[piece] = i
                self.score[piece] = -sp.get_score(i)
                self.raw[i] = piece.replace(SPACE, " ").encode()

    def pairs(self) -> _Pairs:
        if self._pairs is None:
            self._pairs = _Pairs(self)
        return self._pairs

    def segment(self, unit: str, seed: int = SEED, variant: int = 0, rate: float = RATE) -> list[int]:
        """Ids of one unit (with plain spaces)."""
        limit = int(rate * (1 << 64))
        return self.merge(unit, xxhash.xxh3_64_intdigest(unit.encode("utf-8", "surrogatepass"), (seed * 0x9E3779B1 + variant) & _M) if limit else 0, limit)

    def merge(self, unit: str, base: int, limit: int, trace: list[tuple[int, bool]] | None = None) -> list[int]:
        """Ids of one unit; a candidate whose hash with `base` is below `limit` is dropped. `trace` takes (candidate, dropped)."""
        # a literal U+2581 is put out of reach of all pieces, so it ends as bytes
        symbols: list[str | None] = [SPACE if c == " " else "\0" + c if c == SPACE else c for c in unit]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            piece = symbols[i] + symbols[j]
            if piece in score:
                heapq.heappush(agenda, (score[piece], i, j, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, piece = heapq.heappop(agenda)
            if symbols[i] is None or after[i] != j or symbols[j] is None or symbols[i] + symbols[j] != piece:
                continue
            if limit or trace is not None:
                candidate = (i * 0x9E3779B97F4A7C15 + len(piece) * 0xC2B2AE3D27D4EB4F) & _M
                dropped = _drawn(base, candidate) < limit
                if trace is not None:
                    trace.append((candidate, dropped))
                if dropped:
                    continue
            symbols[i], symbols[j] = piece, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                offer(i, after[j])
            if before[i] >= 0:
                offer(before[i], i)
        out = []
        for s in symbols:
            if s is not None:
                if s in self.id:
                    out.append(self.id[s])
                else:
                    out += [self.byte_id[b] for b in s.removeprefix("\0" if len(s) > 1 else "").encode("utf-8", "replace")]
        return out

    def decode(self, ids) -> str:
        """The text of the ids; the space that encoding puts in front is taken off."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


DENSE = 600  # code points whose pairs have a table of their own


class _Pairs:
    """What two neighbouring symbols merge to: an open-addressing table over pairs of symbol numbers.

    Symbols are the pieces' ids, and numbers above them for characters that only stand inside of pieces.
    """

    def __init__(self, model: Model):
        n = len(model.raw)
        self.char = {c: i for c, i in model.id.items() if len(c) == 1}
        for piece in model.id:
            for c in piece:
                if c not in self.char:
                    self.char[c] = n + len(self.char)
        number = {**self.char, **model.id}
        ranks = {x: k for k, x in enumerate(sorted(set(model.score.values())))}
        left, right, made = [], [], []
        for piece, i in model.id.items():
            for k in range(1, len(piece)):
                if piece[:k] in number and piece[k:] in number:
                    left.append(number[piece[:k]])
                    right.append(number[piece[k:]])
                    made.append(i)
        self.rank = np.zeros(n, np.int64)
        for piece, i in model.id.items():
            self.rank[i] = ranks[model.score[piece]]
        key = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.slots = 1 << max(10, 3 + len(key).bit_length())
        self.key, self.made = np.full(self.slots, -1, np.int64), np.zeros(self.slots, np.int32)
        todo, slot = np.arange(len(key)), self._slot(key)
        while len(todo):
            free = self.key[slot] < 0
            self.key[slot[free]] = key[todo[free]]
            got = free & (self.key[slot] == key[todo])
            self.made[slot[got]] = np.array(made, np.int32)[todo[got]]
            todo, slot = todo[~got], (slot[~got] + 1) & (self.slots - 1)
        number = np.array([self.char.get(SPACE, -1) if c == 32 else self.char.get(chr(c), -1) for c in range(DENSE)], np.int64)
        left, right = np.repeat(number, DENSE), np.tile(number, DENSE)
        known = np.flatnonzero((left >= 0) & (right >= 0))
        self.dense = np.full(DENSE * DENSE, -1, np.int32)
        self.dense[known] = self.find(left[known], right[known])
        self.dense = self.dense.reshape(DENSE, DENSE)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.slots.bit_length() + 1)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged piece's id of each pair, or -1."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        out = self.made[slot].astype(np.int64)
        here = self.key[slot]
        out[here < 0] = -1
        on = np.flatnonzero((here >= 0) & (here != key))
        slot = slot[on]
        while len(on):
            slot = (slot + 1) & (self.slots - 1)
            here = self.key[slot]
            out[on] = np.where(here < 0, -1, self.made[slot])
            more = (here >= 0) & (here != key[on])
            on, slot = on[more], slot[more]
        return out


_NONE = np.int32((1 << 31) - 1)


def _draws(base: np.ndarray, candidate: np.ndarray) -> np.ndarray:
    h = base ^ candidate
    for _ in range(2):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h


def _candidate(place: np.ndarray, length: np.ndarray) -> np.ndarray:
    return place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)


def merge_all(model: Model, units: list[str], base: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each unit, candidates that were merged, number of them) for many units at once.

    The agendas of all units advance together: each step takes every unit's best candidate, the leftmost of equals, that
    its hash with the unit's base (none: no draws) does not drop, and merges it.
    """
    size = np.fromiter(map(len, units), np.int64, len(units))
    order = np.argsort(size, kind="stable")
    parts = [_merge_block(model, [units[i] for i in order[k : k + BLOCK].tolist()], order[k : k + BLOCK], size[order[k : k + BLOCK]], base, limit) for k in range(0, len(units), BLOCK)]
    ids, many, rows, found = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate((np.uint32, np.int64, np.int64, np.uint64)))
    counts, begin = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
    counts[order], begin[order] = many, np.cumsum(many) - many
    by = np.argsort(rows, kind="stable")
    return _gather(ids, begin, counts), counts, found[by], np.bincount(rows, minlength=len(units))


def _merge_block(model: Model, units: list[str], own: np.ndarray, size: np.ndarray, base: np.ndarray | None, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, number of ids of each unit, numbers in `own` and candidates of the merges) of units of about one length."""
    pairs = model.pairs()
    n, width = len(units), int(size.max())
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    ends = np.cumsum(size)
    row = np.repeat(np.arange(n), size)
    place = np.arange(len(codes)) - np.repeat(ends - size, size)
    distinct, inverse = np.unique(codes, return_inverse=True)
    numbers = np.array([pairs.char.get(SPACE, -1) if c == 32 else -1 if chr(c) == SPACE else pairs.char.get(chr(c), -1) for c in distinct.tolist()], np.int64)
    # places go down, units across; one place more stands for the end
    symbol = np.full((width + 2, n), -1, np.int32)
    symbol[place, row] = numbers[inverse]
    after = np.repeat(np.arange(1, width + 3, dtype=np.int32)[:, None], n, axis=1)
    after[np.arange(width + 2)[:, None] >= size[None, :]] = width + 1
    after[size - 1, np.arange(n)] = np.minimum(size, width + 1)
    before = np.repeat(np.arange(-1, width + 1, dtype=np.int32)[:, None], n, axis=1)
    agenda = np.full((width + 2, n), _NONE)
    made = np.full((width + 2, n), -1, np.int32)
    seeds = None if base is None else base[own]
    traces: list[tuple[np.ndarray, np.ndarray]] = []
    column = np.arange(n)  # of each unit in the agenda, from which settled units are taken out now and then

    def offer(i: np.ndarray, r: np.ndarray) -> None:
        """Put the pairs that start at places i of units r on the agenda, or take them off it."""
        j = after[i, r]
        a, b = symbol[i, r], symbol[j, r]  # the place after a unit's last has no symbol
        x = np.full(len(i), -1, np.int64)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        x[at] = pairs.find(a[at], b[at])
        put(i, j, r, x)

    def put(i: np.ndarray, j: np.ndarray, r: np.ndarray, x: np.ndarray) -> None:
        if limit and seeds is not None:
            at = np.flatnonzero(x >= 0)
            h = _draws(seeds[r[at]], _candidate(i[at], after[j[at], r[at]] - i[at]))
            x[at[h < np.uint64(limit)] if limit <= _M else at] = -1
        made[i, r] = x
        agenda[i, column[r]] = np.where(x >= 0, (pairs.rank[np.maximum(x, 0)] << 8) | i, _NONE)

    # at first all neighbouring characters, most of them by a small table of their own
    inner = np.flatnonzero(row[1:] == row[:-1])
    a, b = codes[inner], codes[inner + 1]
    common = (a < DENSE) & (b < DENSE)
    x = np.full(len(inner), -1, np.int64)
    x[common] = pairs.dense[a[common], b[common]]
    rare = np.flatnonzero(~common)
    u, v = (symbol[place[inner[rare] + k], row[inner[rare]]] for k in (0, 1))
    both = (u >= 0) & (v >= 0)
    x[rare[both]] = pairs.find(u[both], v[both])
    inner, x = inner[x >= 0], x[x >= 0]
    put(place[inner], place[inner] + 1, row[inner], x)
    live = np.arange(n)
    while len(live):
        best = agenda.min(axis=0)[column[live]]
        on = best < _NONE
        live, best = live[on], best[on]
        if 2 * len(live) < agenda.shape[1]:
            agenda = agenda[:, column[live]]
            column[live] = np.arange(len(live))
        i = (best & 255).astype(np.int64)
        j = after[i, live]
        end = after[j, live]
        traces.append((own[live], _candidate(i, end - i)))
        symbol[i, live] = made[i, live]
        symbol[j, live] = -1
        agenda[j, column[live]] = _NONE
        after[i, live] = end
        before[end, live] = i
        offer(i, live)
        p = before[i, live]
        has = p >= 0
        offer(p[has], live[has])
    # what is left, unit by unit: pieces by their ids, other characters as bytes
    left = np.zeros((width + 2, n), np.bool_)
    at = np.zeros(n, np.int64)
    on = np.arange(n)
    while len(on):
        left[at[on], on] = True
        at[on] = after[at[on], on]
        on = on[at[on] < size[on]]
    r, i = np.nonzero(left.T)
    s = symbol[i, r]
    rows, found = (np.concatenate(x) for x in zip(*traces, strict=True)) if traces else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    plain = (s >= 0) & (s < len(model.raw))
    if not plain.all():
        other = np.flatnonzero(~plain)
        spelled = [[model.byte_id[b] for b in units[r[q]][i[q]].encode("utf-8", "replace")] for q in other.tolist()]
        times = np.ones(len(s), np.int64)
        times[other] = [len(x) for x in spelled]
        r, s = np.repeat(r, times), np.repeat(s, times)
        s[np.repeat(~plain, times)] = np.concatenate([np.array(x, np.int64) for x in spelled])
    return s.astype(np.uint32), np.bincount(r, minlength=n), rows, found


class _Memo:
    """Undropped segmentations by unit: number of the unit, its hash, ids and merged candidates. It holds no draws."""

    def __init__(self, model: Model):
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.hash = np.zeros(0, np.uint64)
        self.ids, self.merged = _Runs(np.uint32), _Runs(np.uint64)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers; new ones are segmented together."""
        out = list(map(self.number.get, units))
        if None in out:
            absent = [i for i, k in enumerate(out) if k is None]
            new = list(dict.fromkeys(map(units.__getitem__, absent)))
            if len(self.number) and len(self.number) + len(new) > MEMO:
                self.empty()
                absent, new = range(len(units)), list(dict.fromkeys(units))
            ids, counts, merged, merges = merge_all(self.model, new, None, 0)
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            self.hash = np.concatenate([self.hash, np.fromiter((xxhash.xxh3_64_intdigest(u.encode("utf-8", "surrogatepass")) for u in new), np.uint64, len(new))])
            self.ids.add(ids, counts)
            self.merged.add(merged, merges)
            for i in absent:
                out[i] = self.number[units[i]]
        return np.array(out, np.int64)


class _Runs:
    """Runs of numbers in one array that grows by doubling."""

    def __init__(self, kind):
        self.data, self.used = np.zeros(1024, kind), 0
        self.start, self.n = np.zeros(1024, np.int64), 0

    def add(self, data: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(data) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        while self.n + len(counts) + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.data[self.used : self.used + len(data)] = data
        self.start[self.n + 1 : self.n + len(counts) + 1] = self.used + np.cumsum(counts)
        self.used += len(data)
        self.n += len(counts)

    def sizes(self, k: np.ndarray) -> np.ndarray:
        return self.start[k + 1] - self.start[k]

    def take(self, k: np.ndarray) -> np.ndarray:
        return _gather(self.data, self.start[k], self.sizes(k))


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs data[at : at + size], one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(at - (ends - size), size) + np.arange(ends[-1])] if len(ends) else data[:0]


_MODELS: dict[str, Model] = {}
_MEMOS: dict[str, _Memo] = {}


def model_of(path: str) -> Model:
    """The worker's model of this file. A function, as closures sent to workers would hold an own copy of the dict."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def memo_of(path: str) -> _Memo:
    if path not in _MEMOS:
        _MEMOS[path] = _Memo(model_of(path))
    return _MEMOS[path]


def _units_of(text: str) -> Iterator[list[str]]:
    """The units of a text, some thousand at a time."""
    text = " " + text
    if len(text) <= 4 * UNITS:
        yield _UNIT.findall(text)
        return
    out: list[str] = []
    for m in _UNIT.finditer(text):
        out.append(m.group())
        if len(out) == UNITS:
            yield out
            out = []
    if out:
        yield out


def encode_texts(texts: list[str | None], path: str, seed: int, documents: list[int], rate: float) -> Iterator[np.ndarray]:
    """The ids of each text; `documents` are keys of the documents, by which their draws differ."""
    owner: list[int] = []  # texts and their numbers of units in the block at hand
    counts: list[int] = []
    firsts: list[int] = []
    units: list[str] = []
    done: dict[int, list[np.ndarray]] = {}

    def flush() -> None:
        for k, part in zip(owner, _encode_units(units, np.array(counts), np.array(firsts), [documents[k] for k in owner], path, seed, rate), strict=True):
            done.setdefault(k, []).append(part)
        owner.clear(), counts.clear(), firsts.clear(), units.clear()

    sent = 0
    for k, text in enumerate(texts):
        at = 0
        for part in _units_of(text) if text else ():
            units += part
            owner.append(k)
            counts.append(len(part))
            firsts.append(at)
            at += len(part)
            if len(units) >= UNITS:
                flush()
        if not units:
            while sent <= k:
                yield np.concatenate(done.pop(sent)) if sent in done else np.zeros(0, np.uint32)
                sent += 1
    if units:
        flush()
    while sent < len(texts):
        yield np.concatenate(done.pop(sent)) if sent in done else np.zeros(0, np.uint32)
        sent += 1


def _encode_units(units: list[str], counts: np.ndarray, firsts: np.ndarray, documents: list[int], path: str, seed: int, rate: float) -> list[np.ndarray]:
    limit, memo = int(rate * (1 << 64)), memo_of(path)
    # every occurrence has a base of its own; those without a dropped candidate have the remembered ids
    starts = np.array([xxhash.xxh3_64_intdigest(d.to_bytes(8, "little"), seed & _M) for d in documents], np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = (np.arange(len(units)) - np.repeat(np.cumsum(counts) - counts - firsts, counts)).astype(np.uint64)
    turn = mix(starts[text] + place * np.uint64(0x9E3779B97F4A7C15))
    short = np.fromiter(map(len, units), np.int64, len(units)) <= MEMO_UNIT
    number = np.zeros(len(units), np.int64)
    if short.all():
        number[:] = memo.numbers(units)
    else:
        number[short] = memo.numbers([units[k] for k in np.flatnonzero(short).tolist()])
    at = np.flatnonzero(short)
    own = number[at]
    size = np.zeros(len(units), np.int64)
    size[at] = memo.ids.sizes(own)
    pool, begin = memo.ids.data, np.zeros(len(units), np.int64)
    begin[at] = memo.ids.start[own]
    extra: list[np.ndarray] = []
    base_at = memo.ids.used
    if limit:
        base = turn[at] ^ memo.hash[own]
        base = mix(base)
        tries = memo.merged.sizes(own)
        which = np.repeat(np.arange(len(at)), tries)
        h = _draws(base[which], memo.merged.take(own))
        again = np.zeros(len(at), np.bool_)
        again[which[h < np.uint64(limit)] if limit <= _M else which] = True
        again = np.flatnonzero(again)
        if len(again):
            ids, n, _, _ = merge_all(memo.model, [units[k] for k in at[again].tolist()], base[again], limit)
            size[at[again]], begin[at[again]] = n, base_at + np.cumsum(n) - n
            extra.append(ids)
            base_at += len(ids)
    for k in np.flatnonzero(~short).tolist():  # long ones one by one
        base = int(mix(np.array([xxhash.xxh3_64_intdigest(units[k].encode("utf-8", "surrogatepass"))], np.uint64) ^ turn[k : k + 1])[0])
        ids = np.array(memo.model.merge(units[k], base, limit), np.uint32)
        size[k], begin[k] = len(ids), base_at
        extra.append(ids)
        base_at += len(ids)
    if extra:
        pool = np.concatenate([pool[: memo.ids.used], *extra])
    flat = _gather(pool, begin, size)
    cuts = np.cumsum(np.add.reduceat(size, np.cumsum(counts) - counts))[:-1]
    return np.split(flat, cuts)


def encode_text(text: str | None, path: str, seed: int, document: int, rate: float) -> np.ndarray:
    """The ids of one text."""
    return next(encode_texts([text], path, seed, [document], rate))


def document_key(id_: object) -> int:
    return xxhash.xxh3_64_intdigest(str(id_))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(id, ids array<int>) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [x.astype(np.int32) for x in encode_texts(b.column(1).to_pylist(), model_path, seed, [document_key(i) for i in b.column(0).to_pylist()], rate)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """rows with the decoded text as the last column; null ids give null."""
    from pyspark.sql import types as T

    where = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)
        for b in batches:
            out = [None if x is None else model.decode(x) for x in b.column(where).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, text_col])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text_col, T.StringType())]))


def digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: float = RATE) -> DataFrame:
    """(id, n_ids, ids_crc32, lossless): digests of the ids (little-endian unsigned 32-bit) and whether they decode to the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            texts = b.column(1).to_pylist()
            for t, ids in zip(texts, encode_texts(texts, model_path, seed, [document_key(i) for i in b.column(0).to_pylist()], rate), strict=True):
                same = model_of(model_path).decode(ids.tolist()) == t if t else True
                for column, v in zip(out, (len(ids), zlib.crc32(ids.tobytes()), same), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["id", "n_ids", "ids_crc32", "lossless"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_ids long, ids_crc32 long, lossless boolean").withColumnRenamed("id", id_col)
