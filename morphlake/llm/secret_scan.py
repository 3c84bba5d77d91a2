"""Secret scans: an Aho-Corasick keyword prefilter, anchored patterns at its hits, checksum validation.

One pass over each text, without a shuffle. Keywords are found by one automaton over the ASCII-lowered text; the
pattern of a kind is only tried at a hit. Runs of hexadecimal digits have no keyword: they come from the edges of such
bytes, found for a whole batch at once. Kinds with a checksum inside (the last six characters of a GitHub or npm
token are the CRC-32 of the thirty before, in base 62) are only reported when it fits.

Null and empty texts have no spans. Repeated rows are scanned each on its own; an empty table gives no rows; more columns,
whatever their names, pass through unused. Time grows with a text's length only, however long its runs are. Spans that
start at one place come in the order of the kinds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, text_bytes

# Kinds in their order, keywords, patterns and least lengths.
KINDS = ("assign", "access", "hex", "crc")
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
CRC = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "crc": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")}
LEAST = {"assign": 8, "access": 16, "hex": 32}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_HEX = np.zeros(256, np.bool_)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _automaton():
    a = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out.rjust(6, "0")


def _lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def keyword_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the kinds with keywords, leftmost and non-overlapping for each kind; too short matches use up their place."""
    found, free = [], dict.fromkeys(KINDS, 0)
    for last, (kind, size) in _AUTOMATON.iter(_lowered(text)):
        at = last - size + 1
        if at < free[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CRC).match(text, at)
        if not m:
            continue
        if kind == "crc":
            if base62_crc(m[1]) != m[2]:
                continue
            keep = True
        else:
            keep = len(m[2] if kind == "assign" else m[0]) >= LEAST[kind]
        free[kind] = m.end()
        if keep:
            found.append((kind, m.start(), m.end()))
    return found


def hex_runs(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end bytes of the runs of LEAST["hex"] or more hexadecimal digits; a run ends with its row."""
    least = LEAST["hex"]
    if len(raw) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_hex = _HEX[raw]
    # every long run holds all of some aligned half-length block: most batches have none
    half = least // 2
    if not is_hex[: len(raw) // half * half].reshape(-1, half).all(axis=1).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(raw) + 1, np.bool_)
    edge[offsets] = True
    first, last = is_hex.copy(), is_hex.copy()
    first[1:] &= ~is_hex[:-1] | edge[1:-1]
    last[:-1] &= ~is_hex[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def scan_batch(column: pa.Array) -> Iterator[list[tuple[str, int, int]]]:
    """For each row its spans (kind, start, end) in code points, by start and then kind."""
    raw, offsets = text_bytes(column)
    starts, ends = hex_runs(raw, offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    of: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
        of.setdefault(r, []).append((a, b))
    data = raw.tobytes()
    for i in range(len(offsets) - 1):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        text = data[lo:hi].decode("utf-8", "replace")
        spans = keyword_spans(text)
        for a, b in of.get(i, ()):
            start = a - lo if len(text) == hi - lo else len(data[lo:a].decode("utf-8", "replace"))
            spans.append(("hex", start, start + b - a))
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        yield spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) for each row of docs."""
    from pyspark.sql import functions as F

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in scan_batch(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], names=["id", "spans"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as a string, one row for each row."""
    from pyspark.sql import functions as F

    schema = pa.schema([("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {f.name: [] for f in schema}
            for spans in scan_batch(b.column(1)):
                base = [s for s in spans if s[0] != "crc"]
                for k in ("assign", "access", "hex"):
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            made = batch_of(schema, out)
            yield pa.RecordBatch.from_arrays([b.column(0), *made.columns], names=["id", *schema.names])

    kind = docs.schema[id_col].dataType.simpleString()
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    return made.withColumnRenamed("id", id_col)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by mask; overlapping spans become one. Rows without spans stay as they are."""
    names = docs.columns
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, out = b.column(where), []
            for text, spans in zip(column.to_pylist(), scan_batch(column), strict=True):
                if spans:
                    parts, at = [], 0
                    for _, s, e in spans:
                        if s >= at:
                            parts += [text[at:s], mask]
                        at = max(at, e)
                    text = "".join([*parts, text[at:]])
                out.append(text)
            columns = list(b.columns)
            columns[where] = pa.array(out, column.type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
