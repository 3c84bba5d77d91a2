"""Exact substring dedup over a sparse suffix array, sorted deep-shallow.

Removed is each byte that some string of `length` bytes covers which starts anywhere else too, in any document.

Anchors: a k-gram whose hash is the least of some stretch of `length` bytes. Equal stretches have equal anchors at equal
places, so the repeated strings all meet in the groups of equal anchors, and only about 1.2 % of the positions are
sorted: a sparse suffix array, partitioned by anchor. In a group the suffixes from the anchor on, and the reversed texts
before it, are ordered deep-shallow: multikey quicksort on eight-byte characters down to a shallow depth (every pass
splits the open parts of all the groups at hand), then a blind trie (branching characters and depths only) for each
remaining part with a long common prefix. Both orders give common extensions r and l; an occurrence with r + l >= length
for another one loses the bytes [p - max l, p + max r).

Scale: rows of one text are folded first (a text with copies goes as a whole). The texts are exchanged once, by digest,
and that exchange serves the anchors, the contexts and the result. Anchors are found once; each task folds the
occurrences of a locally frequent anchor into lists, which get a partition of their own beside the anchor's other
occurrences, so a hot anchor is spread from the start. Anchors that occur once end there. No group holds more than
`block` occurrences; what an anchor's several blocks leave open is decided by counting the distinct stretches of all
those blocks by hash, so no group meets in one task. Long texts are read in windows, whatever their length.

Texts are UTF-8 bytes; null and shorter ones lose nothing. Rows with equal texts are documents of their own, repeated
ids included. An empty table gives no rows; other columns, whatever their names, are kept or not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, free_name, frugal, materialize, mix, pieces, powers, text_bytes

LENGTH = 200
GRAM = 32
BLOCK = 4096  # contexts of one group: 1.5 MB of text
HOT_BLOCKS = 16  # blocks from which an anchor counts as hot
SHALLOW = 48
PAIRS = 64  # distinct contexts of a group up to which its orders are walked pair by pair, not depth by depth

# ---------------------------------------------------------------- anchors


def _slide(x: np.ndarray, w: int, best, fill: int) -> np.ndarray:
    """best (minimum or maximum) of each w neighbours: result[i] is over x[i : i + w]."""
    n = len(x)
    padded = np.full(-(-n // w) * w, fill, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[: n - w + 1], ahead[w - 1 : n])


def _anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, pinv = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    h = mix((sums[gram:] - sums[:-gram]) * pinv[: n - gram + 1]) | np.uint64(1)
    w = length - gram + 1
    low = _slide(h, w, np.minimum, (1 << 64) - 1)  # of the stretch that starts here
    whole = np.zeros(len(low), np.bool_)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= length:
            whole[a : b - length + 1] = True
    low[~whole] = 0
    padded = np.zeros(len(low) + 2 * (w - 1), np.uint64)
    padded[w - 1 : w - 1 + len(low)] = low
    at = np.flatnonzero(_slide(padded, w, np.maximum, 0)[: len(h)] == h)
    return at, h[at]


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in raw, 64-bit keys) of the anchors, some rows or one window of a long row at a time.

    No stretch crosses a row. A window has all stretches around its positions, so it finds what the whole row would.
    """
    for i, j in chunks(offsets, limit):
        first, end = int(offsets[i]), int(offsets[j])
        if end - first <= 2 * limit:
            at, keys = _anchors(raw[first:end], offsets[i : j + 1] - first, length, gram)
            yield at + first, keys
            continue
        for a in range(first, end, limit):
            lo, hi = max(first, a - length), min(end, a + limit + length)
            at, keys = _anchors(raw[lo:hi], np.array([0, hi - lo]), length, gram)
            at += lo
            own = (at >= a) & (at < a + limit)
            yield at[own], keys[own]


_OCC = 20  # bytes of an occurrence: the text's digest and the position


def _packed(parts: list[np.ndarray], ends: np.ndarray) -> pa.Array:
    """A binary column of rows of bytes; `ends` are the rows' ends in the joined parts."""
    data = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
    at = np.zeros(len(ends) + 1, np.int32)
    at[1:] = ends
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return text_bytes(column)[0].reshape(-1, width)


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, block: int, local: int) -> Iterator[pa.RecordBatch]:
    """(key, salt, occurrences): one row an occurrence; those of an anchor that a batch of texts has `local` times in
    lists, under a salt of some tasks, and an empty row under salt 0 that says so."""
    context = TaskContext.get()
    salt = 1 + (context.partitionId() if context else 0) // max(1, block // local)
    for b in batches:
        digest = _fixed(b.column("digest"), 16)
        fresh = np.ones(len(digest), np.bool_)
        fresh[1:] = (digest[1:] != digest[:-1]).any(axis=1)  # copies of a text stand beside each other as a rule
        if not fresh.all():
            b, digest = b.filter(pa.array(fresh)), digest[fresh]
        raw, offsets = text_bytes(b.column("text"))
        found = list(anchors(raw, offsets, length, gram))
        if not found:
            continue
        at, keys = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        if not len(at):
            continue
        row = np.searchsorted(offsets, at, "right") - 1
        occ = np.empty((len(at), _OCC), np.uint8)
        occ[:, :16] = digest[row]
        occ[:, 16:] = (at - offsets[row]).astype("<i4")[:, None].view(np.uint8)
        order = np.argsort(keys, kind="stable")
        keys, occ = keys[order], occ[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        count = np.diff(np.append(first, len(keys)))
        often = np.repeat(count >= local, count)
        single = keys[~often]
        out_keys, out_salts, parts, sizes = [single], [np.zeros(len(single), np.int64)], [occ[~often].ravel()], [np.full(len(single), _OCC)]
        hot = np.flatnonzero(count >= local)
        if len(hot):
            out_keys.append(keys[first[hot]])
            out_salts.append(np.zeros(len(hot), np.int64))
            sizes.append(np.zeros(len(hot), np.int64))
            for k in hot.tolist():
                for a in range(first[k], first[k] + count[k], block):
                    e = min(a + block, first[k] + count[k])
                    out_keys.append(keys[a : a + 1])
                    out_salts.append(np.array([salt]))
                    parts.append(occ[a:e].ravel())
                    sizes.append(np.array([(e - a) * _OCC]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_keys).view(np.int64)), pa.array(np.concatenate(out_salts)), _packed(parts, np.cumsum(np.concatenate(sizes)))], names=["key", "salt", "occ"])


_ASK = 24  # bytes of a request: key, block (0: the anchor has no other), position, and room


def _requests(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """(digest, ask) for every occurrence that has a partner, from rows sorted by (key, salt).

    An anchor's occurrences stay together up to `block`; where it has several blocks, each has a number above 0.
    """

    def asked(key: np.ndarray, number: np.ndarray, occ: np.ndarray) -> pa.RecordBatch:
        ask = np.zeros((len(key), _ASK), np.uint8)
        ask[:, :8] = key[:, None].view(np.uint8)
        ask[:, 8:16] = number.astype(np.int64)[:, None].view(np.uint8)
        ask[:, 16:20] = occ[:, 16:]
        n = len(key)
        return pa.RecordBatch.from_arrays([_packed([np.ascontiguousarray(occ[:, :16]).ravel()], np.arange(1, n + 1) * 16), _packed([ask.ravel()], np.arange(1, n + 1) * _ASK)], names=["digest", "ask"])

    def split(key: np.ndarray, salt: np.ndarray, count: np.ndarray, occ: np.ndarray, given: int) -> pa.RecordBatch:
        """Whole runs: the rows' keys, salts and numbers of occurrences; `given` blocks of the first run are out already."""
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        parted = (salt[first] > 0) | (np.bincount(run, count == 0) > 0)
        if given:
            parted[0] = True
        of = np.repeat(run, count)
        total = np.bincount(of, minlength=len(first))
        use = ((total > 1) | parted)[of]
        of, occ = of[use], occ[use]
        if len(of):
            words = np.ascontiguousarray(occ[:, :16]).view("<u8")
            pos = np.ascontiguousarray(occ[:, 16:]).view("<i4").ravel()
            order = np.lexsort((pos, words[:, 1], words[:, 0], of))
            of, words, pos, occ = of[order], words[order], pos[order], occ[order]
            again = np.zeros(len(of), np.bool_)  # of a text with copies
            again[1:] = (of[1:] == of[:-1]) & (words[1:] == words[:-1]).all(axis=1) & (pos[1:] == pos[:-1])
            of, occ = of[~again], occ[~again]
            total = np.bincount(of, minlength=len(first))
            use = ((total > 1) | parted)[of]
            of, occ = of[use], occ[use]
        start = np.cumsum(np.bincount(of, minlength=len(first)))
        start = np.concatenate([[0], start])[:-1]
        number = (np.arange(len(of)) - start[of]) // block
        if given:
            number[of == 0] += given
        several = parted | (total > block)
        number = np.where(several[of], (salt[first][of] << 32) + number + 1, 0)
        return asked(key[first][of], number, occ)

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    held_n, given = 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        data, ends = text_bytes(b.column("occ"))
        count = np.diff(ends) // _OCC
        rows = (b.column("key").to_numpy(), b.column("salt").to_numpy(), count, data.reshape(-1, _OCC))
        if held:
            held.append(rows)
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        key, salt, count, occ = rows
        last = int(np.flatnonzero((key != key[-1]) | (salt != salt[-1]))[-1]) + 1 if (key[0], salt[0]) != (key[-1], salt[-1]) else 0
        if last:
            at = int(count[:last].sum())
            yield split(key[:last], salt[:last], count[:last], occ[:at], given)
            key, salt, count, occ, given = key[last:], salt[last:], count[last:], occ[at:], 0
        held_n = int(count.sum())
        if held_n >= 4 * block:  # a run longer than this goes out in parts
            out = split(key, salt, count, occ, max(given, 1))
            yield out
            given = max(given, 1) + -(-held_n // block)
            key, salt, count, occ = key[:1], salt[:1], np.zeros(1, count.dtype), occ[:0]
        held = [(key, salt, count, occ)]
    if held:
        key, salt, count, occ = held[0]
        yield split(key, salt, count, occ, given)


def _context_rows(batches: Iterator[pa.RecordBatch], length: int, gram: int, step: int = 4096) -> Iterator[pa.RecordBatch]:
    """(key, number, digest, pos, left, context) for the asked anchors of each text."""
    before = length - gram
    for b in batches:
        digest = _fixed(b.column("digest"), 16)
        fresh = np.ones(len(digest), np.bool_)
        fresh[1:] = (digest[1:] != digest[:-1]).any(axis=1)
        if not fresh.all():
            b, digest = b.filter(pa.array(fresh)), digest[fresh]
        raw, offsets = text_bytes(b.column("text"))
        lists = b.column("asked")
        ask = _fixed(lists.flatten(), _ASK)
        row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy())
        pos = np.ascontiguousarray(ask[:, 16:20]).view("<i4").ravel().astype(np.int64)
        at = offsets[row] + pos
        lo, hi = np.maximum(offsets[row], at - before), np.minimum(offsets[row + 1], at + length)
        for k in range(0, len(row), step):
            part = slice(k, k + step)
            size = hi[part] - lo[part]
            ends = np.cumsum(size)
            take = np.repeat(lo[part] - (ends - size), size) + np.arange(ends[-1])
            n = len(size)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(ask[part, :8]).view("<i8").ravel()), pa.array(np.ascontiguousarray(ask[part, 8:16]).view("<i8").ravel()),
                    _packed([np.ascontiguousarray(digest[row[part]]).ravel()], np.arange(1, n + 1) * 16),
                    pa.array(pos[part].astype(np.int32)), pa.array((at[part] - lo[part]).astype(np.int32)), _packed([raw[take]], ends),
                ],
                names=["key", "number", "digest", "pos", "left", "context"],
            )


_CONTEXT = "key long, number long, digest binary, pos int, left int, context binary"


# ---------------------------------------------------------------- deep-shallow sorting


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    return n - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8


class BlindTrie:
    """A trie that keeps branching depths and characters only; a string is compared once, with the leaf it falls to."""

    __slots__ = ("strings", "root")

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self._insert(i)

    @staticmethod
    def _char(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def _insert(self, i: int) -> None:
        # a node is [depth, {character: node}]; a leaf is a list of equal strings as [-1, [numbers]]
        if self.root is None:
            self.root = [-1, [i]]
            return
        s, node = self.strings[i], self.root
        while node[0] >= 0:
            children = node[1]
            node = children.get(self._char(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[1][0]]
        depth = common_prefix(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            return
        above, node = None, self.root
        while 0 <= node[0] < depth:
            above, node = node, node[1][self._char(s, node[0])]
        if node[0] == depth:
            node[1][self._char(s, depth)] = [-1, [i]]
            return
        made = [depth, {self._char(other, depth): node, self._char(s, depth): [-1, [i]]}]
        if above is None:
            self.root = made
        else:
            above[1][self._char(s, above[0])] = made

    def order(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            depth, own = stack.pop()
            if depth < 0:
                out += own
            else:
                stack += [child for _, child in sorted(own.items(), reverse=True)]
        return out


def _words(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as eight-byte characters that compare like the bytes."""
    return strings.view(">u8").astype(np.uint64)


def shared(words: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefixes, in bytes, of the rows a with the rows b."""
    out = np.empty(len(a), np.int64)
    for k in range(0, len(a), 1 << 15):
        x, y = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
        differ = words[x] ^ words[y]
        at = (differ != 0).argmax(axis=1)
        top = differ[np.arange(len(x)), at]
        same = sum((top < np.uint64(1 << (64 - 8 * i))).astype(np.int64) for i in range(1, 8))
        out[k : k + len(x)] = np.minimum(np.where(top == 0, words.shape[1] * 8, at * 8 + same), np.minimum(size[x], size[y]))
    return out


def deep_shallow(strings: np.ndarray, size: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, common prefix of each with the one before it; 0 where a group starts) of the strings of every group.

    strings: rows of bytes padded with zeros to a multiple of eight, the true lengths beside them; groups ascend.
    """
    n = len(strings)
    words = _words(strings)
    order = np.arange(n)
    new = np.ones(n, np.bool_)  # a part starts at this place of the order
    new[1:] = group[1:] != group[:-1]
    starts = new.copy()

    def open_places() -> tuple[np.ndarray, np.ndarray]:
        part = np.cumsum(new) - 1
        return np.flatnonzero((np.bincount(part) > 1)[part]), part

    for depth in range(min(shallow // 8, words.shape[1])):
        at, part = open_places()
        if not len(at):
            break
        c = words[order[at], depth]
        o = np.lexsort((c, part[at]))
        order[at], c = order[at][o], c[o]
        new[at[1:]] |= c[1:] != c[:-1]
    at, part = open_places()
    if len(at):
        # equal strings of a part come side by side, by a hash that is then confirmed; one of each goes into the trie
        odd = mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64)) | np.uint64(1)
        h = mix((words[order[at]] * odd).sum(axis=1) ^ size[order[at]].astype(np.uint64))
        o = np.lexsort((h, part[at]))
        order[at], own = order[at][o], part[at]
        rows = order[at]
        same = np.zeros(len(at), np.bool_)
        same[1:] = (own[1:] == own[:-1]) & (size[rows[1:]] == size[rows[:-1]]) & (words[rows[1:]] == words[rows[:-1]]).all(axis=1)
        first = np.flatnonzero(~same)  # of each run of equal strings
        length = np.diff(np.append(first, len(at)))
        part_of = own[first]
        cuts = np.flatnonzero(np.concatenate([[True], part_of[1:] != part_of[:-1]]))
        many = np.diff(np.append(cuts, len(first)))
        placed = np.arange(len(first))
        pair = cuts[many == 2]
        if len(pair):  # a trie of two leaves is one comparison
            x, y = rows[first[pair]], rows[first[pair + 1]]
            both = shared(words, size, x, y)
            wide = strings.shape[1]
            cx, cy = (np.where(both < size[k], strings[k, np.minimum(both, wide - 1)].astype(np.int64), -1) for k in (x, y))
            turn = pair[cx > cy]
            placed[turn], placed[turn + 1] = turn + 1, turn
        for k in np.flatnonzero(many > 2).tolist():
            a = cuts[k]
            members = rows[first[a : a + many[k]]]
            trie = BlindTrie([strings[i, : size[i]].tobytes() for i in members.tolist()])
            placed[a : a + many[k]] = a + np.array(trie.order())
        run = length[placed]
        ends = np.cumsum(run)
        order[at] = rows[np.repeat(first[placed] - (ends - run), run) + np.arange(len(at))]
    lcp = np.zeros(n, np.int64)
    inner = np.flatnonzero(~starts)
    lcp[inner] = shared(words, size, order[inner - 1], order[inner])
    return order, lcp


# ---------------------------------------------------------------- groups


def _classes(order: np.ndarray, lcp: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """A number for each string that only equal ones of its group share."""
    same = np.zeros(len(order), np.bool_)
    same[1:] = (group[order[1:]] == group[order[:-1]]) & (lcp[1:] == size[order[1:]]) & (lcp[1:] == size[order[:-1]])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~same)
    return out


class _Least:
    """Minima of ranges, by a sparse table."""

    def __init__(self, x: np.ndarray, longest: int):
        self.rows = [x]
        step = 1
        while 2 * step <= longest:
            y = self.rows[-1]
            self.rows.append(np.minimum(y[:-step], y[step:]) if len(y) > step else y)
            step *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of x[a + 1 : b + 1], a < b."""
        level = np.log2(b - a).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            row = self.rows[k]
            out[at] = np.minimum(row[a[at] + 1], row[b[at] + 1 - (1 << k)])
        return out


def reach(rights: np.ndarray, size_r: np.ndarray, lefts: np.ndarray, size_l: np.ndarray, group: np.ndarray, length: int, before: int) -> tuple[np.ndarray, np.ndarray]:
    """For each occurrence the bytes before and from its anchor that repeated stretches around it cover, or -1 and -1."""
    n = len(group)
    best_l, best_r = np.full(n, -1), np.full(n, -1)
    if n < 2:
        return best_l, best_r
    order_r, lcp_r = deep_shallow(rights, size_r, group)
    order_l, lcp_l = deep_shallow(lefts, size_l, group)
    both = _classes(order_r, lcp_r, size_r, group) * (n + 1) + _classes(order_l, lcp_l, size_l, group)
    _, one, inverse, copies = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
    whole = (copies > 1) & (size_l[one] + size_r[one] >= length)  # equal contexts cover all they have
    left, right = np.where(whole, size_l[one], -1), np.where(whole, size_r[one], -1)

    # one occurrence stands for its equals: m of them, in the order of the groups
    m = len(one)
    number = np.full(n, -1)
    number[one] = np.arange(m)

    def thinned(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(representatives in this order, common prefixes of neighbours, rank of each)."""
        at = np.flatnonzero(number[order] >= 0)
        low = np.minimum.reduceat(lcp, np.append(0, at[:-1] + 1)) if m else lcp[:0]  # least since the one before
        o = number[order[at]]
        rank = np.empty(m, np.int64)
        rank[o] = np.arange(m)
        return o, low, rank

    order_r, lcp_r, rank_r = thinned(order_r, lcp_r)
    order_l, lcp_l, rank_l = thinned(order_l, lcp_l)
    own = group[one]
    in_order = own[order_r]
    _, where, sizes = np.unique(own, return_inverse=True, return_counts=True)
    big = sizes[where] > PAIRS
    if (sizes > 1).any():
        least = _Least(lcp_l, int(sizes.max()))
        # neighbours one, two, three apart, as long as they share enough
        a = np.flatnonzero(~big[order_r])
        low = np.full(len(a), length)
        for step in range(1, min(int(sizes.max()), PAIRS)):
            fit = a + step < m
            a, low = a[fit], low[fit]
            low = np.minimum(low, lcp_r[a + step])
            fit = (in_order[a] == in_order[a + step]) & (low >= length - before)
            a, low = a[fit], low[fit]
            if not len(a):
                break
            i, j = order_r[a], order_r[a + step]
            x = least.between(np.minimum(rank_l[i], rank_l[j]), np.maximum(rank_l[i], rank_l[j]))
            ok = x + low >= length
            for k in (i[ok], j[ok]):
                np.maximum.at(left, k, x[ok])
                np.maximum.at(right, k, low[ok])
    if big.any():
        # every depth parts the two orders; who shares both parts shares the stretch that starts so far before the anchor
        sel = np.flatnonzero(big)
        first, last = np.full(m, -1), np.full(m, -1)
        sr, sl = size_r[one], size_l[one]
        for x in range(before + 1):
            here = sel[(sl[sel] >= x) & (sr[sel] >= length - x)]
            if len(here) < 2:
                continue
            part_r, part_l = np.cumsum(lcp_r < length - x), np.cumsum((lcp_l < x) | (np.concatenate([[True], own[order_l][1:] != own[order_l][:-1]])))
            key = part_r[rank_r[here]] * (m + 1) + part_l[rank_l[here]]
            o = np.argsort(key, kind="stable")
            same = key[o][1:] == key[o][:-1]
            again = np.zeros(len(here), np.bool_)
            again[o[1:][same]] = True
            again[o[:-1][same]] = True
            again = here[again]
            first[again[first[again] < 0]] = x
            last[again] = x
        met = first >= 0
        left = np.where(met, np.maximum(left, last), left)
        right = np.where(met, np.maximum(right, length - first), right)
    return left[inverse], right[inverse]


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.Table]:
    """The sorted rows again, in tables of whole groups (key, number): of twice `rows` at most, or of a larger group and `rows`."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in (b.slice(i, rows) for b in batches for i in range(0, b.num_rows, rows)):
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        key, number = t.column("key").to_numpy(), t.column("number").to_numpy()
        cut = np.flatnonzero((key != key[-1]) | (number != number[-1]))
        if len(cut):
            at = int(cut[-1]) + 1
            yield t.slice(0, at)
            held = t.slice(at).to_batches()
            n -= at
    if held:
        yield pa.Table.from_batches(held)


_FOUND = "digest binary, s int, e int, key long, h binary, many boolean"


def _settled(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Spans that a group shows (digest, s, e), and of anchors in several blocks the block's distinct stretches: (digest and
    start of the first, key, hash, whether there are more)."""
    before = length - gram
    wide_r, wide_l = -(-length // 8) * 8, -(-before // 8) * 8

    def spans(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, number = t.column("key").to_numpy(), t.column("number").to_numpy()
        digest = _fixed(t.column("digest"), 16)
        pos, left = t.column("pos").to_numpy().astype(np.int64), t.column("left").to_numpy().astype(np.int64)
        raw, offsets = text_bytes(t.column("context"))
        # one row for each place (a text with copies may have asked twice)
        place = np.concatenate([digest.view("<u8"), np.stack([pos, number, key], axis=1).view(np.uint64)], axis=1)
        order = np.lexsort((place[:, 2], place[:, 1], place[:, 0], number, key))
        fresh = np.ones(len(order), np.bool_)
        fresh[1:] = (place[order][1:] != place[order][:-1]).any(axis=1)
        order = order[fresh]
        key, number, digest, pos, left, offsets_a, offsets_e = key[order], number[order], digest[order], pos[order], left[order], offsets[:-1][order], offsets[1:][order]
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]) | (number[1:] != number[:-1])]))
        right = offsets_e - offsets_a - left

        def matrix(first: np.ndarray, size: np.ndarray, width: int, back: bool) -> np.ndarray:
            out = np.zeros((len(first), width), np.uint8)
            for k in range(0, len(first), 1024):  # the places take forty times the bytes
                a, s = first[k : k + 1024], size[k : k + 1024]
                ends = np.cumsum(s)
                inside = np.arange(int(ends[-1])) - np.repeat(ends - s, s)
                row = np.repeat(np.arange(k, k + len(s)), s)
                out[row, inside] = raw[np.repeat(a, s) + (-inside if back else inside)]
            return out

        rights, lefts = matrix(offsets_a + left, right, wide_r, False), matrix(offsets_a + left - 1, left, wide_l, True)
        best_l, best_r = reach(rights, right, lefts, left, group, length, before)
        hit = np.flatnonzero(best_l >= 0)
        n = len(hit)
        empty = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.bool_())]
        yield pa.RecordBatch.from_arrays([_packed([digest[hit].ravel()], np.arange(1, n + 1) * 16), pa.array((pos[hit] - best_l[hit]).astype(np.int32)), pa.array((pos[hit] + best_r[hit]).astype(np.int32)), *empty], names=["digest", "s", "e", "key", "h", "many"])
        several = np.flatnonzero(number > 0)
        if len(several):
            words = digest.view("<u8")
            _, text = np.unique(words[several], axis=0, return_inverse=True)
            place = (text.ravel() << 32) + pos[several] - left[several]
            whole = np.flatnonzero(np.concatenate([[True], np.diff(group[several]) > 0]))  # first rows of blocks
            cuts = [0]
            for k in np.append(whole[1:], len(several)).tolist():
                if k - cuts[-1] > BLOCK or k == len(several):
                    cuts.append(k)
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                own = several[a:e]
                sizes = offsets_e[own] - offsets_a[own]
                part = _gathered(raw, offsets_a[own], sizes)
                yield from _stretches(part, sizes, left[own], group[own], place[a:e], key[own], digest[own], pos[own] - left[own], length, before)

    for t in _whole_groups(batches):
        yield from spans(t)


def _gathered(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return raw[np.repeat(first - (ends - size), size) + np.arange(int(ends[-1]))]


_PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_BASES = (1103515245, 1597334677, 851723965, 1911520717)


def _fingerprints(raw: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the strings raw[at : at + length]: polynomials over four primes, packed to two numbers."""
    out = []
    for p, base in zip(_PRIMES, _BASES, strict=True):
        # powers repeat in rows, so that the sums stay small and one inverse serves a place of a row
        row = 1 << 12
        power = np.ones(row, np.uint64)
        for k in range(12):
            step = pow(base, 1 << k, p)
            power[1 << k : 2 << k] = power[: 1 << k] * np.uint64(step) % np.uint64(p)
        h = np.zeros(len(at), np.uint64)
        for k in range(0, len(raw), row - length + 1):
            lo, hi = np.searchsorted(at, (k, k + row - length + 1))
            if lo == hi:
                continue
            piece = raw[k : k + row]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
            i = at[lo:hi] - k
            # times the power that is missing to the row's last one, so that equal strings agree
            h[lo:hi] = (sums[i + length] - sums[i]) % np.uint64(p) * power[row - 1 - i] % np.uint64(p)
        out.append(h)
    return out[0] << np.uint64(31) | out[1], out[2] << np.uint64(31) | out[3]


def _stretches(raw, size, left, group, place, key, digest, start, length: int, before: int) -> Iterator[pa.RecordBatch]:
    """The distinct stretches of each block (a group) by fingerprint: one row each, at the first place where it stands."""
    ends = np.cumsum(size)
    data = raw.tobytes()
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[e - n : e] + x.to_bytes(4, "little")) for e, n, x in zip(ends.tolist(), size.tolist(), left.tolist(), strict=True)), "<u8").reshape(-1, 2)
    order = np.lexsort((both[:, 1], both[:, 0], group))
    first = np.ones(len(order), np.bool_)
    first[1:] = (group[order][1:] != group[order][:-1]) | (both[order][1:] != both[order][:-1]).any(axis=1)
    counts = np.diff(np.append(np.flatnonzero(first), len(order)))
    one = order[first]  # of equal contexts one
    back = np.argsort(one, kind="stable")
    one, counts = one[back], counts[back]
    lo, hi = np.maximum(0, left[one] - before), np.minimum(left[one], size[one] - length) + 1
    n = np.maximum(hi - lo, 0)
    if not n.sum():
        return
    context = np.repeat(np.arange(len(one)), n)
    s = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[context]
    a, b = _fingerprints(raw, (ends - size)[one][context] + s, length)
    at = place[one][context] + s
    order = np.lexsort((b, a, group[one][context]))
    new = np.ones(len(order), np.bool_)
    g = group[one][context][order]
    new[1:] = (g[1:] != g[:-1]) | (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    begin = np.flatnonzero(new)
    # more than the stretch itself by its next equal anchor: equal contexts, or another place
    many = (np.maximum.reduceat(counts[context[order]], begin) > 1) | (np.maximum.reduceat(at[order], begin) != np.minimum.reduceat(at[order], begin))
    rep = order[begin]
    row = one[context[rep]]
    h = np.stack([a[rep], b[rep]], axis=1).view(np.uint8)
    for k in range(0, len(rep), 20_000):
        q = slice(k, k + 20_000)
        m = len(rep[q])
        yield pa.RecordBatch.from_arrays(
            [_packed([np.ascontiguousarray(digest[row[q]]).ravel()], np.arange(1, m + 1) * 16), pa.array((start[row[q]] + s[rep[q]]).astype(np.int32)), pa.nulls(m, pa.int32()), pa.array(key[row[q]]), _packed([np.ascontiguousarray(h[q]).ravel()], np.arange(1, m + 1) * 16), pa.array(many[q])],
            names=["digest", "s", "e", "key", "h", "many"],
        )


# ---------------------------------------------------------------- the operator


def removed_spans(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, local: int | None = None) -> DataFrame:
    """Struct `row` of docs' other columns (in their order), `text`, `digest`, `copies` (rows of this text) and `spans`
    array<struct<s,e>> (unmerged byte ranges), one row for each row of docs."""
    if local is None:  # as often as a task would have an anchor that comes to HOT_BLOCKS blocks
        local = max(32, HOT_BLOCKS * block // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hashed: Column = F.coalesce(F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))), F.lit(b""))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0).alias("none")]
    # the one exchange of whole texts; every use below has these columns, so Spark reuses it
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), hashed.alias("digest"))
    counted = materialize(rows.groupBy("digest").agg(F.count("*").alias("copies")), "texts")
    one = rows.join(counted, "digest")
    keyed = one.select("row", "text", "digest").mapInArrow(frugal(lambda it: _anchor_rows((b.select(["text", "digest"]) for b in it), length, gram, block, local)), "key long, salt long, occ binary")
    asked = (
        keyed.repartition("key", "salt").sortWithinPartitions("key", "salt")
        .mapInArrow(frugal(lambda it: _requests(it, block)), "digest binary, ask binary")
        .groupBy("digest").agg(F.collect_list("ask").alias("asked"))
    )
    met = (
        rows.join(asked, "digest").select("row", "digest", "text", "asked")
        .mapInArrow(frugal(lambda it: _context_rows((b.select(["digest", "text", "asked"]) for b in it), length, gram)), _CONTEXT)
        .repartition("key", "number").sortWithinPartitions("key", "number")
    )
    found = materialize(met.mapInArrow(frugal(lambda it: _settled(it, length, gram)), _FOUND), "spans")
    local_spans = found.where("h is null").select("digest", "s", "e")
    # a stretch of several blocks: where any has it twice, or two have it at different places, all of them go
    place = F.struct("digest", "s")
    across = (
        found.where("h is not null").groupBy("key", "h")
        .agg(F.max("many").alias("many"), F.min(place).alias("lo"), F.max(place).alias("hi"), F.collect_list(F.when(~F.col("many"), place)).alias("x"))
        .where("many or lo != hi").select(F.explode("x").alias("x")).select("x.digest", "x.s", (F.col("x.s") + length).alias("e"))
    )
    spans = local_spans.union(across).groupBy("digest").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    known = counted.select("digest", "copies").join(spans, "digest", "left")
    return rows.join(known, "digest").select("row", "text", "digest", "copies", "spans")


def _cuts(column: pa.Array) -> Iterator[np.ndarray]:
    """For each row its spans as sorted, merged (start, end) rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat = column.flatten()
    s, e = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    at = 0
    for n in sizes.tolist():
        if not n:
            yield np.zeros((0, 2), np.int64)
            continue
        a, b = s[at : at + n].astype(np.int64), e[at : at + n].astype(np.int64)
        at += n
        o = np.argsort(a, kind="stable")
        a, b = a[o], np.maximum.accumulate(b[o])
        new = np.concatenate([[True], a[1:] > b[:-1]])
        yield np.stack([a[new], b[np.append(np.flatnonzero(new)[1:] - 1, n - 1)]], axis=1)


def _cut(text: bytes, copies: int, runs: np.ndarray, length: int) -> tuple[bytes, int]:
    """(what is left, number of removed runs)."""
    if copies > 1 and len(text) >= length:
        return b"", 1
    if not len(runs):
        return text, 0
    ends = runs.ravel().tolist()
    return b"".join(text[a:b] for a, b in zip([0, *ends[1::2]], [*ends[::2], len(text)], strict=True)), len(runs)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, local: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in pieces(b, "text")):
            out: list[list] = [[], [], [], []]
            for text, copies, spans in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("copies").to_pylist(), _cuts(b.column("spans")), strict=True):
                text = text or b""
                kept, runs = _cut(text, copies, spans, length)
                for column, v in zip(out, (len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    light = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = light.schema["id"].dataType.simpleString()
    out = removed_spans(light, "text", length, gram, block, local).select("row.id", "text", "copies", "spans")
    return out.mapInArrow(frugal(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)


def strip(docs: DataFrame, text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, local: int | None = None) -> DataFrame:
    """docs with the repeated bytes taken out of their texts (a character cut in two goes as well); no row is dropped."""
    schema = docs.schema
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (p for b in batches for p in pieces(b, where)):
            out = []
            texts = b.column(where).cast(pa.binary()).to_pylist()
            for text, copies, spans in zip(texts, b.column(len(schema)).to_pylist(), _cuts(b.column(len(schema) + 1)), strict=True):
                out.append(text if text is None else _cut(text, copies, spans, length)[0].decode("utf-8", "ignore"))
            columns = list(b.columns)[: len(schema)]
            columns[where] = pa.array(out, b.column(where).type)
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    got = removed_spans(docs, text_col, length, gram, block, local)
    copies, spans = free_name(docs, "copies"), free_name(docs, "spans")
    own = [(F.col("text") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return got.select(*own, F.col("copies").alias(copies), F.col("spans").alias(spans)).mapInArrow(frugal(run), schema)
