"""Best-fit packing of tokenised documents into fixed-length sequences by bin completion.

Tokens: the ids of a public tokenizer, then one end id. Words between ASCII white space are encoded on their own (this
tokenizer's rules never cross white space), each distinct word once for some time, through a memo of bounded size. Only
documents longer than a sequence are cut. Long texts are read in parts cut at white space, whatever their length (one
word without white space is the least part).

Packing works on the histogram of piece lengths (at most `capacity` rows whatever the corpus's size, so it may come to
the driver). Best-fit decreasing over runs of equal lengths gives the first incumbent; where that is above the lower
bound, branch and bound goes depth first: around the largest remaining length it enumerates the undominated fillings,
least waste first (one piece, two, three and so on, guided by the sums that so many pieces reach), prunes what would waste
more than an improvement allows, and makes best-fit ends of its paths new incumbents. The nodes are bounded by a multiple
of the number of distinct lengths, the steps of each by a constant; of plans with equally many bins the one found first stands. The plan is a list of
(filling, times). Pieces get ranks among those of their length (salted, so that a frequent length is spread), and a rank
says sequence and offset by a binary search in the plan.

Null texts are empty: their piece is the end id alone. Repeated rows are packed each on their own; an empty table gives
no rows; more columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, Words, chunks, materialize, text_bytes, word_parts

CAPACITY = 4096
END_ID = 1
MEMO_SLOTS = 1 << 21  # of a worker's table of words: 17 bytes each, and the ids beside it

# ---------------------------------------------------------------- tokens


class WordIds:
    """Ids by 64-bit word hash: a table with open addressing, at most three quarters full, in NumPy arrays.

    A full table keeps the words that were asked for again since they came, up to half of it.
    """

    def __init__(self, slots: int = MEMO_SLOTS):
        self.slots = slots
        self.empty()

    def empty(self) -> None:
        self.key = np.zeros(self.slots, np.uint64)
        self.at, self.size = np.zeros(self.slots, np.int32), np.zeros(self.slots, np.int32)
        self.again = np.zeros(self.slots, np.bool_)
        self.pool, self.used, self.n = np.zeros(self.slots, np.uint32), 0, 0

    def _step(self, slot: np.ndarray) -> np.ndarray:
        return (slot + 1) & (self.slots - 1)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of distinct keys, -1 for those that are not here."""
        out = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            here = self.key[slot]
            hit = here == keys[todo]
            out[todo[hit]] = slot[hit]
            on = ~hit & (here != 0)
            todo, slot = todo[on], self._step(slot[on])
        self.again[out[out >= 0]] = True
        return out

    def put(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct keys that are not here yet; ids one after another."""
        if 4 * (self.n + len(keys)) > 3 * self.slots or self.used + len(ids) > len(self.pool) * 4:
            self._thin()
            if 4 * (self.n + len(keys)) > 3 * self.slots:
                return
        ends = np.cumsum(sizes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool) // 2, np.uint32)])
        self.pool[self.used : self.used + len(ids)] = ids
        todo = np.arange(len(keys))
        slot = (keys & np.uint64(self.slots - 1)).astype(np.int64)
        while len(todo):
            free = self.key[slot] == 0
            self.key[slot[free]] = keys[todo[free]]  # of two for one slot the last gets it
            got = free & (self.key[slot] == keys[todo])
            at, own = slot[got], todo[got]
            self.at[at], self.size[at], self.again[at] = self.used + ends[own] - sizes[own], sizes[own], False
            todo, slot = todo[~got], self._step(slot[~got])
        self.used += len(ids)
        self.n += len(keys)

    def _thin(self) -> None:
        stay = np.flatnonzero(self.again & (self.key != 0))[: self.slots // 2]
        keys, sizes, ids = self.key[stay], self.size[stay].astype(np.int64), self.ids(stay)
        self.empty()
        if 2 * len(ids) < 4 * len(self.pool):
            self.put(keys, sizes, ids)

    def ids(self, slots: np.ndarray) -> np.ndarray:
        return _gather(self.pool, self.at[slots].astype(np.int64), self.size[slots].astype(np.int64))


def _gather(pool: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs pool[at : at + size], one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(at - (ends - size), size) + np.arange(ends[-1])] if len(ends) else pool[:0]


_STATE: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _STATE:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _STATE[path] = (Tokenizer.from_file(path), WordIds())
    return _STATE[path]


# classes of bytes for words of plain shape: 1 letter, 2 digit, 3 other sign, 4 first byte of a Latin letter, 5 its second, 0 none
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[0x27, 0x3C]] = 0  # an apostrophe may part a word elsewhere, < may open a special token
_CLASS[0xC3] = 4
_CLASS[[*range(0x80, 0x97), *range(0x98, 0xB7), *range(0xB8, 0xC0)]] = 5


def _plain_words(part: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the number of units that the tokenizer's pattern cuts it to (runs of letters, single digits, runs of
    other signs) where plain bytes tell it, else 0."""
    size = end - start
    ends = np.cumsum(size)
    c = _CLASS[_gather(part, start, size)]
    first = np.zeros(len(c), np.bool_)
    first[ends - size] = True
    before = np.concatenate([[0], c[:-1]])
    before[first] = 0
    after = np.concatenate([c[1:], [0]])
    after[ends - 1] = 0
    bad = (c == 0) | ((c == 4) & (after != 5)) | ((c == 5) & (before != 4))
    kind = np.where(c >= 4, 1, c)
    last = np.where(before >= 4, 1, before)
    cut = (kind != last) | (kind == 2)
    at = ends - size
    return np.where(np.add.reduceat(bad, at), 0, np.add.reduceat(cut, at, dtype=np.int64)) if len(at) else size


_TOGETHER = 64


def _encoded(data: bytes, start: list[int], end: list[int], units: np.ndarray, tok) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, number of each word's ids). Words with a number of units come first: they are encoded many at a
    time, and parted by counting the ids that end a unit."""
    plain = int((units > 0).sum())
    words = [data[a:e].decode("utf-8", "replace") for a, e in zip(start, end, strict=True)]
    ends_unit = _unit_ends(tok)
    if ends_unit is None:
        plain = 0
    texts = [" ".join(words[k : min(k + _TOGETHER, plain)]) for k in range(0, plain, _TOGETHER)] + words[plain:]
    found = [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
    groups = len(texts) - (len(words) - plain)
    n = int(sizes[:groups].sum())
    if plain:
        closes = np.flatnonzero(ends_unit[ids[:n]])
        last = np.cumsum(units[:plain])
        if len(closes) != last[-1]:
            raise RuntimeError("this tokenizer cuts words otherwise than its pattern says")
        each = np.diff(closes[last - 1], prepend=-1)
        sizes = np.concatenate([each, sizes[groups:]])
    return ids, sizes


def _unit_ends(tok) -> np.ndarray | None:
    """Which ids end a unit, for tokenizers that mark it by an end-of-word suffix and cut words by the known pattern."""
    key = id(tok)
    if key not in _ENDS:
        model = json.loads(tok.to_str())
        suffix = model["model"].get("end_of_word_suffix")
        if suffix and _PATTERN in json.dumps(model["pre_tokenizer"], ensure_ascii=False):
            ends = np.zeros(tok.get_vocab_size(), np.bool_)
            for piece, i in tok.get_vocab().items():
                ends[i] = piece.endswith(suffix)
            _ENDS[key] = ends
        else:
            _ENDS[key] = None
    return _ENDS[key]


_ENDS: dict[int, np.ndarray | None] = {}
_PATTERN = json.dumps(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")[1:-1]  # fixed value: the pattern of this vocabulary


def _part_ids(part: np.ndarray, offsets: np.ndarray, tok, memo: WordIds) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, where rows start in them)."""
    w = Words(part, offsets, False)
    w.hash[w.hash == 0] = 1
    keys, where, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
    slot = memo.find(keys)
    missing = np.flatnonzero(slot < 0)
    sizes = np.zeros(len(keys), np.int64)
    known = np.flatnonzero(slot >= 0)
    sizes[known] = memo.size[slot[known]]
    pool, at = memo.ids(slot[known]), np.zeros(len(keys), np.int64)
    at[known] = np.cumsum(sizes[known]) - sizes[known]
    if len(missing):
        # those of plain shape first: they are encoded many at a time
        several = _plain_words(part, w.start[where[missing]], w.end[where[missing]])
        order = np.argsort(several == 0, kind="stable")
        missing, several = missing[order], several[order]
        ids, sizes[missing] = _encoded(part.tobytes(), w.start[where[missing]].tolist(), w.end[where[missing]].tolist(), several, tok)
        at[missing] = len(pool) + np.cumsum(sizes[missing]) - sizes[missing]
        pool = np.concatenate([pool, ids])
        short = sizes[missing] <= 64
        if not short.all():
            ids = ids[np.repeat(short, sizes[missing])]
        memo.put(keys[missing[short]], sizes[missing[short]], ids)
    flat = _gather(pool, at[inverse], sizes[inverse])
    return flat, np.concatenate([[0], np.cumsum(sizes[inverse])])[w.row]


def token_ids(raw: np.ndarray, offsets: np.ndarray, path: str) -> Iterator[np.ndarray]:
    """The ids of each row as uint32, without the end id."""
    tok, memo = _tokenizer(path)
    for i, j in chunks(offsets):
        first, end = int(offsets[i]), int(offsets[j])
        if end - first <= 2 * CHUNK_BYTES:
            flat, cut = _part_ids(raw[first:end], offsets[i : j + 1] - first, tok, memo)
            for k in range(j - i):
                yield flat[cut[k] : cut[k + 1]]
        else:
            parts = [_part_ids(raw[a:b], np.array([0, b - a]), tok, memo)[0] for a, b in word_parts(raw, first, end)]
            yield np.concatenate(parts)


PIECES = "id {kind}, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(id, piece, start, length, ids_crc32): the documents cut to at most capacity tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            out: list[list] = [[], [], [], [], []]
            for row, ids in enumerate(token_ids(raw, offsets, tokenizer_path)):
                ids = np.concatenate([ids.astype("<u4"), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, v in zip(out, (row, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], names=["id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES.format(kind=kind))


# ---------------------------------------------------------------- bins

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over runs of equal lengths: (filling, times)."""
    open_: dict[int, list[tuple[Filling, int]]] = defaultdict(list)  # by room left
    done: list[tuple[Filling, int]] = []
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            fits, groups, rest = room // length, open_.pop(room), []
            for filling, times in groups:
                used = min(times, n // fits)
                if used:
                    open_[room - fits * length].append(((*filling, (length, fits)), used))
                    n -= used * fits
                    times -= used
                if times and n:  # fewer than one bin's fill are left
                    open_[room - n * length].append(((*filling, (length, n)), 1))
                    n, times = 0, times - 1
                if times:
                    rest.append((filling, times))
            if rest:
                open_[room] += rest
            if not n:
                break
        if n:
            fits = capacity // length
            if n // fits:
                open_[capacity - fits * length].append((((length, fits),), n // fits))
            if n % fits:
                open_[capacity - n % fits * length].append((((length, n % fits),), 1))
        done += open_.pop(0, [])
    return done + [g for groups in open_.values() for g in groups]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that no packing can do without: by volume, and by lengths of which no two share a bin."""
    big = sum(n for length, n in counts.items() if 2 * length > capacity)
    return max(-(-sum(length * n for length, n in counts.items()) // capacity), big)


MOST_PIECES = 12  # beside the largest piece, in an enumerated filling; more are filled in longest first
STEPS = 2_000  # of the enumeration around one piece; then the single piece and the longest-first filling are left


class _Search:
    """What is left to pack, with undo: counts by length, and the set of lengths as the bits of one number."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left, self.capacity = dict(counts), capacity
        self.lengths = sum(1 << x for x in counts)
        self.refresh()

    def refresh(self) -> None:
        """sums[k]: what exactly k of the lengths add up to, repeats allowed; stays a superset as lengths run out."""
        self.least = (self.lengths & -self.lengths).bit_length() - 1
        self.sums = [1, self.lengths]

    def reached(self, k: int) -> int:
        lengths = [x for x, n in self.left.items() if n] if len(self.sums) <= k else ()
        while len(self.sums) <= k:
            out, below, mask = 0, self.sums[-1], (1 << self.capacity + 1) - 1
            for x in lengths:
                out |= below << x
            self.sums.append(out & mask)
        return self.sums[k]

    def longest(self, space: int) -> int:
        """The longest length left that fits, or -1."""
        return (self.lengths & (1 << space + 1) - 1).bit_length() - 1

    def take(self, filling: Filling, times: int) -> None:
        for x, c in filling:
            self.left[x] -= c * times
            if not self.left[x]:
                self.lengths &= ~(1 << x)

    def put_back(self, filling: Filling, times: int) -> None:
        for x, c in filling:
            self.left[x] += c * times
            self.lengths |= 1 << x

    def parts(self, total: int, k: int, most: int, steps: list[int]) -> Iterator[tuple[int, ...]]:
        """All descending k lengths of this total, none above `most`, while there are steps."""
        if k == 1:
            if total <= most and self.lengths >> total & 1:
                yield (total,)
            return
        x = self.longest(min(most, total - (k - 1) * self.least))
        below = self.reached(k - 1)
        while x * k >= total and x > 0 and steps[0] > 0:
            steps[0] -= 1
            if below >> (total - x) & 1:
                for rest in self.parts(total - x, k - 1, x, steps):
                    yield (x, *rest)
            x = self.longest(x - 1)

    def dominated(self, pieces: tuple[int, ...], waste: int) -> bool:
        """Whether one other length left could stand for two of the pieces (then what it frees is of more use elsewhere)."""
        for u in {pieces[a] + pieces[b] for a in range(len(pieces)) for b in range(a)}:
            v = self.lengths >> u & (1 << waste + 1) - 1
            if v:
                return True
        return False

    def fillings(self, space: int, worst: int) -> Iterator[tuple[int, ...]]:
        """Undominated fillings of the space that waste at most `worst`, least waste first, few pieces first.

        One length dominates every shorter one and all sets up to its size, so below the longest that fits, only it counts.
        """
        single = self.longest(space)
        if single < 0:
            if space <= worst:
                yield ()
            return
        steps = [STEPS]
        if single < space:
            for total in range(space, max(single, space - worst - 1), -1):
                for k in range(2, MOST_PIECES + 1):
                    if k * self.least > total or steps[0] <= 0:
                        break
                    if self.reached(k) >> total & 1:
                        for pieces in self.parts(total, k, single, steps):
                            fits = all(self.left[x] >= pieces.count(x) for x in set(pieces))
                            if fits and not self.dominated(pieces, space - total):
                                yield pieces
        if space - single <= worst:
            yield (single,)
        # longer fillings than those enumerated
        room, greedy, free = space, [], {}
        while (x := self.longest(room)) > 0:
            while x > 0 and free.setdefault(x, self.left[x]) == 0:
                x = self.longest(x - 1)
            if x <= 0:
                break
            c = min(free[x], room // x)
            free[x] -= c
            room -= c * x
            greedy += [x] * c
        if len(greedy) > MOST_PIECES and room <= worst:
            yield tuple(greedy)


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = None) -> list[tuple[Filling, int]]:
    """(filling, times) in as few bins as found: best fit first, then branch and bound.

    nodes: how many bins the search may try; by default 2,000 and four for each distinct length.
    """
    counts = {x: n for x, n in counts.items() if n}
    best = best_fit(counts, capacity)
    size = lambda plan: sum(t for _, t in plan)
    fewest, least, total = size(best), lower_bound(counts, capacity), sum(x * n for x, n in counts.items())
    if fewest <= least:
        return best
    left = 2_000 + 4 * len(counts) if nodes is None else nodes
    look = max(1, len(counts) // 16)  # bins of a path between two looks at its best-fit end
    s = _Search(counts, capacity)
    path: list[tuple[Filling, int]] = []
    used = wasted = 0

    def choices() -> Iterator[tuple[Filling, int]]:
        """The bins to try around the longest length left: as often as they can be filled, and then once."""
        top = s.longest(capacity)
        s.left[top] -= 1
        if not s.left[top]:
            s.lengths &= ~(1 << top)
        slack = (fewest - 1) * capacity - total - wasted
        once = []
        try:
            for pieces in s.fillings(capacity - top, slack):
                whole = (top, *pieces)
                filling = tuple((x, whole.count(x)) for x in sorted(set(whole), reverse=True))
                s.left[top] += 1
                s.lengths |= 1 << top
                times = min(s.left[x] // c for x, c in filling)
                yield filling, times
                if times > 1 and len(once) < 64:
                    once.append(filling)
                s.left[top] -= 1
                if not s.left[top]:
                    s.lengths &= ~(1 << top)
        finally:
            s.left[top] += 1
            s.lengths |= 1 << top
        for filling in once:
            yield filling, 1

    stack = [choices()]
    while stack and left and fewest > least:
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if path and len(path) > len(stack) - 1:
                filling, times = path.pop()
                used -= times
                wasted -= times * (capacity - sum(x * c for x, c in filling))
                s.put_back(filling, times)
            continue
        filling, times = step
        lost = times * (capacity - sum(x * c for x, c in filling))
        left -= 1
        if wasted + lost > (fewest - 1) * capacity - total:
            continue  # a better plan has one bin less: what all its bins waste is bounded
        s.take(filling, times)
        path.append(step)
        used, wasted = used + times, wasted + lost
        if left % 64 == 0:
            s.refresh()
        done = not s.lengths
        if done or len(path) % look == 0:
            end = [] if done else best_fit({x: n for x, n in s.left.items() if n}, capacity)
            if used + size(end) < fewest:
                best, fewest = [*path, *end], used + size(end)
        if done:
            path.pop()
            used, wasted = used - times, wasted - lost
            s.put_back(filling, times)
        else:
            stack.append(choices())
    return best


# ---------------------------------------------------------------- placing


def _places(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, how many in a bin, first bin, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    bin_ = 0
    for filling, times in plan:
        offset = 0
        for length, c in filling:
            out[length].append((rank[length], c, bin_, offset))
            rank[length] += c * times
            offset += c * length
        bin_ += times
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, nodes: int | None = None) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = _places(bin_completion(counts, capacity, nodes))
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("id", "piece"), F.lit(salts)))
    # rows before a salt's among those of its length; at most capacity * salts rows
    before = cut.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = cut.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece", "ids_crc32"))).join(before, ["length", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else ():
                n = int(length[own[0]])
                p = places[n]
                at = p[np.searchsorted(p[:, 0], rank[own], "right") - 1]
                q, r = np.divmod(rank[own] - at[:, 0], at[:, 1])
                seq[own], off[own] = at[:, 2] + q, at[:, 3] + r * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = ranked.select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1 + F.col("base")).alias("rank"))
    return ranked.mapInArrow(run, PIECES.format(kind=kind) + ", sequence_id long, offset long").withColumnRenamed("id", id_col)
