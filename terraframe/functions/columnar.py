"""Whole columns of text and binary geometries by array operations.

A column's bytes are read or written in a few passes over one buffer, whatever the
number of vertices or rows.  Readers take what is regular (text of the declared
type with plain numbers, little-endian binary of the declared type and
dimensions) and say which rows they have left to the reader of single values.

Between buffers and Arrow arrays stands :class:`Flat`: all coordinates in order,
and for each level of nesting the number of children of each node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..types import CoordType, GeometryType, GeomType

#: Levels of lists in each native type.
LEVEL = {1: 0, 2: 1, 3: 2, 4: 1, 5: 2, 6: 3}
#: Bytes of a column, or of one long text, that are looked at together: what is known of each byte takes some twenty more.
PIECE = 4 << 20
MARKS = {1: [], 2: ["Z"], 3: ["M"], 4: ["ZM"]}


@dataclass
class Flat:
    """``good``: the rows that are read.  ``counts``: children of each node, rows first (none for other rows)."""

    good: np.ndarray
    coords: np.ndarray
    counts: list[np.ndarray]

    @property
    def per_row(self) -> np.ndarray:
        """Coordinates of each row."""
        if not self.counts:
            return self.good.astype(np.int64)
        n = self.counts[-1]
        for above in reversed(self.counts[:-1]):
            n = summed(n, above)
        return n


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of so many values."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def buffers(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets into them and validity of a text or binary column."""
    a = a.cast(pa.large_binary())
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0], np.asarray(a.is_valid())


def in_pieces(a: pa.Array, f: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """``f`` of a column, taken over runs of rows of some PIECE bytes or of one longer row."""
    if a.nbytes <= PIECE or len(a) < 2:
        return f(a)
    size = pc.binary_length(a) if pa.types.is_string(a.type) or pa.types.is_binary(a.type) else None
    n = np.full(len(a), a.nbytes // len(a)) if size is None else pc.fill_null(size, 0).to_numpy(zero_copy_only=False)
    begins = np.flatnonzero(np.diff(np.concatenate([[-1], np.cumsum(n) // PIECE])))
    return pa.concat_arrays([f(a[b:e]) for b, e in zip(begins, [*begins[1:], len(a)])])


def texts(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of a buffer as a text column."""
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data)))


# -- native arrays --------------------------------------------------------------------


def assembled(flat: Flat, t: GeomType) -> pa.Array:
    """The native array; rows that are not good are null."""
    width, missing = len(t.ordinates), pa.array(~flat.good)
    c = flat.coords
    if t.level == 0:
        full = np.full((len(flat.good), width), np.nan)
        full[flat.good] = c
        c = full
    c = np.ascontiguousarray(c)
    top = missing if t.level == 0 else None
    if t.coord_type == CoordType.SEPARATE:
        out = pa.StructArray.from_arrays([pa.array(c[:, i]) for i in range(width)], list(t.ordinates), mask=top)
    else:
        out = pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1, dtype=np.int32) * width), pa.array(c.ravel()), mask=top)
    for k in range(len(flat.counts) - 1, -1, -1):
        off = pa.array(np.concatenate([[0], np.cumsum(flat.counts[k])]).astype(np.int32))
        out = pa.ListArray.from_arrays(off, out, mask=missing if k == 0 else None)
    return out


def disassembled(a: pa.Array, t: GeomType) -> Flat:
    good = np.asarray(a.is_valid())
    counts = []
    width = len(t.ordinates)
    if t.level == 0:
        a = a.drop_null()
    for _ in range(t.level):
        counts.append(pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = a.flatten()
    if t.coord_type == CoordType.SEPARATE:
        c = np.stack([pc.struct_field(a, [i]).to_numpy(zero_copy_only=False) for i in range(width)], 1) if len(a) else np.zeros((0, width))
    else:
        c = a.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return Flat(good, c.astype(np.float64, copy=False), counts)


# -- text -----------------------------------------------------------------------------

_OTHER, _SPACE, _NUMBER, _OPEN, _CLOSE, _COMMA = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t\r\n")] = _SPACE
_CLASS[list(b"0123456789+-.eE")] = _NUMBER
_CLASS[ord("(")], _CLASS[ord(")")], _CLASS[ord(",")] = _OPEN, _CLOSE, _COMMA
_HEAD = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ \t\r\n")
_REGULAR = r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"


def heads(a: pa.Array) -> pa.Array:
    """Of each text what stands before the first parenthesis, as a dictionary column."""
    data, off, _ = buffers(a)
    first = _first(data, off)
    inside = _inside(len(data), off[:-1], first)
    return texts(data[inside], first - off[:-1]).dictionary_encode()


def _first(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    opens = np.concatenate([np.flatnonzero(data == ord("(")), [len(data)]])
    return np.minimum(opens[np.searchsorted(opens, off[:-1])], off[1:])


def _inside(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def read_wkt(a: pa.Array, t: GeomType) -> Flat:
    """Regular text of the type: its name, its mark, nested lists of coordinates of plain numbers."""
    if len(a) == 1 and LEVEL[int(t.geometry_type)] == 1 and a.nbytes > PIECE:
        found = _read_long(a, t)
        if found:
            return found
    return _read_regular(a, t)


def _read_long(a: pa.Array, t: GeomType) -> Flat | None:
    """One long list of coordinates, cut at commas: regular if every piece is.  None: not a list, or no comma for a whole piece."""
    data, _, _ = buffers(a)
    opens = np.flatnonzero(data[:PIECE] == ord("("))
    ends = np.flatnonzero(_CLASS[data[-PIECE:]] != _SPACE)
    if not len(opens) or not len(ends) or data[-PIECE:][ends[-1]] != ord(")"):
        return None
    at, last = int(opens[0]) + 1, max(len(data) - PIECE, 0) + int(ends[-1])
    head, coords, to = data[:at].tobytes(), [], -1
    while to < last:
        to = last
        if last - at > PIECE:
            commas = np.flatnonzero(data[at : at + PIECE] == ord(","))
            if not len(commas):
                return None
            to = at + int(commas[-1])
        flat = _read_regular(pa.array([head + data[at:to].tobytes() + b")"], pa.binary()), t)
        if not flat.good[0]:
            return Flat(flat.good, flat.coords, flat.counts)
        coords.append(flat.coords)
        at = to + 1
    return Flat(np.ones(1, bool), np.concatenate(coords), [np.array([sum(map(len, coords))], np.int64)])


def _read_regular(a: pa.Array, t: GeomType) -> Flat:
    kind, width, deepest = int(t.geometry_type), len(t.ordinates), max(LEVEL[int(t.geometry_type)], 1)
    data, off, good = buffers(a)
    good = good.copy()
    n = len(good)
    head = heads(a)
    want = [GeometryType(kind).name, *MARKS[int(t.dimensions)]]
    fits = np.array([h.split() == want and set(h) <= _HEAD for h in head.dictionary.to_pylist()] or [False])
    good &= fits[head.indices.to_numpy()] if n else good
    first = _first(data, off)
    body_len = off[1:] - first
    body = data[~_inside(len(data), off[:-1], first)]
    start = np.concatenate([[0], np.cumsum(body_len)])
    cls = _CLASS[body]

    def spoil(rows_of: np.ndarray) -> None:
        good[np.searchsorted(start, rows_of, side="right") - 1] = False

    spoil(np.flatnonzero(cls == _OTHER))
    number = cls == _NUMBER
    begins = number.copy()
    begins[1:] &= ~number[:-1]
    spoil(np.flatnonzero(begins & (body == ord("+"))))  # the other reader refuses it
    at = np.flatnonzero(begins | (cls >= _OPEN))  # tokens; a body begins with a parenthesis, so numbers never run over rows
    kinds = cls[at]
    row = np.searchsorted(start, at, side="right") - 1
    depth = np.cumsum((kinds == _OPEN).astype(np.int32) - (kinds == _CLOSE))
    new = np.ones(len(at), bool)
    new[1:] = row[1:] != row[:-1]
    last = np.ones(len(at), bool)
    last[:-1] = new[1:]
    base = np.concatenate([[0], depth])[np.flatnonzero(new)]
    depth = depth - np.repeat(base, np.diff(np.concatenate([np.flatnonzero(new), [len(at)]])))
    before = np.concatenate([[_OTHER], kinds[:-1]]) if len(at) else kinds
    before = np.where(new, _OTHER, before)
    inner = depth == deepest
    bad = np.select(
        [kinds == _OPEN, kinds == _NUMBER, kinds == _COMMA],
        [
            (depth > deepest) | (depth < 1) | ~(new | (before == _OPEN) | (before == _COMMA)),
            ~inner | ~((before == _OPEN) | (before == _COMMA) | (before == _NUMBER)),
            (before != np.where(inner, _NUMBER, _CLOSE)) | (depth < 1) | (kind == 1),
        ],
        (before != np.where(depth + 1 == deepest, _NUMBER, _CLOSE)) | (depth < 0) | (depth > deepest),
    )
    bad |= (depth == 0) != last
    run = (kinds == _NUMBER) & (before != _NUMBER)
    runs = np.flatnonzero(run)
    after = np.concatenate([kinds[1:], [_OTHER]]) if len(at) else kinds
    run_ends = np.flatnonzero((kinds == _NUMBER) & ((after != _NUMBER) | last))
    if len(runs) == len(run_ends):
        bad[runs[run_ends - runs + 1 != width]] = True
    good[row[bad]] = False
    good &= np.bincount(row, minlength=n)[:n] > 0 if n else good

    while True:
        keep = good[row]
        byte_keep = number & np.repeat(good, body_len)
        starts = at[keep & (kinds == _NUMBER)]
        ends = np.flatnonzero(byte_keep & ~np.concatenate([number[1:], [False]])) + 1 if len(body) else starts
        words = texts(body[byte_keep], ends - starts)
        try:
            values = words.cast(pa.float64()).to_numpy(zero_copy_only=False)
            break
        except pa.ArrowInvalid:
            odd = ~pc.match_substring_regex(words, _REGULAR).to_numpy(zero_copy_only=False)
            good[row[keep & (kinds == _NUMBER)][odd]] = False
    kinds, depth, run = kinds[keep], depth[keep], run[keep]
    counts = []
    for d in range(1, LEVEL[kind] + 1):
        open_ = (kinds == _OPEN) & (depth == d)
        child = run if d == deepest else (kinds == _OPEN) & (depth == d + 1)
        c = np.bincount(np.cumsum(open_)[child] - 1, minlength=int(open_.sum()))
        if d == 1:
            full = np.zeros(n, np.int64)
            full[good] = c
            c = full
        counts.append(c.astype(np.int64))
    return Flat(good, values.reshape(-1, width), counts)


# -- binary ---------------------------------------------------------------------------


def codes(data: np.ndarray, off: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """The type codes of little-endian values, -1 for others, null and short ones."""
    out = np.full(len(valid), -1, np.int64)
    rows = np.flatnonzero(valid & (np.diff(off) >= 5))
    rows = rows[data[off[rows]] == 1]
    out[rows] = _u32(data, off[rows] + 1)
    return out


def _u32(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sum(data[at + k].astype(np.int64) << (8 * k) for k in range(4))


def read_wkb(a: pa.Array, t: GeomType) -> Flat:
    """Little-endian values of the type and dimensions, without an SRID and bytes behind."""
    kind, width = int(t.geometry_type), len(t.ordinates)
    data, off, valid = buffers(a)
    n, size = len(valid), 8 * len(t.ordinates)
    code = 1000 * (int(t.dimensions) - 1)
    good = valid & (codes(data, off, valid) == kind + code)
    pos, end = off[:-1].copy(), off[1:]
    marks: list[tuple[np.ndarray, int]] = []  # places of headers and their length
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(LEVEL[kind])]  # (row, count) by level

    def take(rows: np.ndarray, level: int, head: int, member: int | None, what: int) -> tuple[np.ndarray, np.ndarray]:
        """Read a count with ``head`` bytes (4, or 9 with order and code) at the rows' places; ``what``: least bytes of a child."""
        fits = pos[rows] + head <= end[rows]
        if member is not None:
            ok = rows[fits]
            fits[fits] = (data[pos[ok]] == 1) & (_u32(data, pos[ok] + 1) == member + code)
        ok = rows[fits]
        c = _u32(data, pos[ok] + head - 4)
        right = (pos[ok] + head + c * what <= end[ok]) & ((c > 0) | (level == 0))  # empty parts are left to the other reader
        good[rows] = False
        ok, c = ok[right], c[right]
        good[ok] = True
        marks.append((pos[ok].copy(), head))
        pos[ok] += head
        found[level].append((ok, c))
        return ok, c

    rows = np.flatnonzero(good)
    if kind == 1:
        good &= off[1:] - off[:-1] == 5 + size
        marks.append((off[:-1][good], 5))
        pos[good] = end[good]
    elif kind == 2:
        ok, c = take(rows, 0, 9, None, size)
        pos[ok] += c * size
    elif kind == 4:
        ok, c = take(rows, 0, 9, None, 5 + size)
        own = np.repeat(pos[ok], c) + (np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)) * (5 + size)
        wrong = (data[own] != 1) | (_u32(data, own + 1) != 1 + code) if len(own) else np.zeros(0, bool)
        good[np.repeat(ok, c)[wrong]] = False
        marks.append((own, 5))
        pos[ok] += c * (5 + size)
    else:
        left = np.zeros(n, np.int64)
        ok, c = take(rows, 0, 9, None, 4)
        left[ok] = c
        rings = np.zeros(n, np.int64)
        while len(rows := np.flatnonzero(good & ((left > 0) | (rings > 0)))):
            if kind == 6:  # a polygon's header where its rings are done
                some = rows[rings[rows] == 0]
                ok, c = take(some, 1, 9, 3, 4)
                left[ok] -= 1
                rings[ok] = c
                some = rows[good[rows] & (rings[rows] > 0)]
                ok, c = take(some, 2, 4, None, size)
                rings[ok] -= 1
            else:
                ok, c = take(rows, 1, 4 if kind == 3 else 9, None if kind == 3 else 2, size)
                left[ok] -= 1
            pos[ok] += c * size
    good &= pos == end  # bytes behind are left to the other reader
    counts = []
    for k, parts in enumerate(found):
        at = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, np.int64)
        c = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, np.int64)
        order = np.argsort(at, kind="stable")
        at, c = at[order], c[order]
        c, at = c[good[at]], at[good[at]]
        if k == 0:
            full = np.zeros(n, np.int64)
            full[at] = c
            c = full
        counts.append(c)
    inside = np.repeat(good, np.diff(off))
    for at, head in marks:
        for k in range(head):
            inside[at + k] = False
    return Flat(good, data[inside].view("<f8").reshape(-1, width), counts)


def write_wkb(flat: Flat, t: GeomType, big_endian: bool = False) -> pa.Array:
    """ISO binary of each good row, null for others."""
    kind, width, good = int(t.geometry_type), len(t.ordinates), flat.good
    end, n, size = "<>"[big_endian], len(flat.good), 8 * len(t.ordinates)
    code = 1000 * (int(t.dimensions) - 1)
    # headers by level: the geometry's code in each, and whether a count follows
    member = {1: [], 2: [], 3: [None], 4: [1], 5: [2], 6: [3, None]}[kind]
    head = [5 if kind == 1 else 9] + [4 if m is None else 5 if m == 1 else 9 for m in member]
    counts = [c[good] if k == 0 else c for k, c in enumerate(flat.counts)]
    if kind == 4:
        counts.append(np.ones(int(counts[0].sum()), np.int64))
    nodes = int(good.sum())
    sizes = [head[-1] + (counts[-1] if counts and kind != 4 else np.ones(nodes if not counts else len(counts[-1]), np.int64)) * size]
    for k in range(len(head) - 2, -1, -1):
        sizes.insert(0, head[k] + summed(sizes[0], counts[k]))
    starts = [np.cumsum(sizes[0]) - sizes[0]]
    for k in range(1, len(head)):
        before = np.cumsum(sizes[k]) - sizes[k]
        first = np.cumsum(counts[k - 1]) - counts[k - 1]
        own = np.repeat(np.arange(len(counts[k - 1])), counts[k - 1])
        starts.append(starts[k - 1][own] + head[k - 1] + before - before[first[own]] if len(own) else before)
    total = int(sizes[0].sum())
    out, free = np.zeros(total, np.uint8), np.ones(total, bool)
    for k, (h, s) in enumerate(zip(head, starts)):
        own = kind if k == 0 else member[k - 1]
        rec = np.zeros((len(s), h), np.uint8)
        if h != 4:
            rec[:, 0] = not big_endian
            rec[:, 1:5] = np.frombuffer(np.array([own + code], end + "u4").tobytes(), np.uint8)
        if h != 5:
            rec[:, -4:] = counts[k].astype(end + "u4").view(np.uint8).reshape(-1, 4)
        for j in range(h):
            out[s + j] = rec[:, j]
            free[s + j] = False
    out[free] = np.ascontiguousarray(flat.coords).astype(end + "f8", copy=False).view(np.uint8).ravel()
    lengths = np.zeros(n, np.int64)
    lengths[good] = sizes[0]
    if total >= 1 << 31:
        raise ValueError("more than 2 GB of binary geometries in one batch")
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    valid = None if good.all() else pa.py_buffer(np.packbits(good, bitorder="little").tobytes())
    assert width * 8 == size
    return pa.BinaryArray.from_buffers(pa.binary(), n, [valid, pa.py_buffer(offsets), pa.py_buffer(out)])


# -- bounds of serialized columns -------------------------------------------------------


def bounds(flat: Flat) -> np.ndarray:
    """(xmin, ymin, xmax, ymax) of each good row, NaN ignored; of nothing an inverted infinite box."""
    n = flat.per_row[flat.good]
    out = np.full((len(n), 4), np.inf)
    out[:, 2:] = -np.inf
    some = n > 0
    if some.any():
        first = (np.cumsum(n) - n)[some]
        for j, (axis, f) in enumerate(((0, np.fmin), (1, np.fmin), (0, np.fmax), (1, np.fmax))):
            v = f.reduceat(flat.coords[:, axis], first)
            out[some, j] = np.where(np.isnan(v), np.inf if j < 2 else -np.inf, v)
    return out


def kinds_of(a: pa.Array, wkt: bool) -> list[tuple[np.ndarray, int, int]]:
    """(rows, kind, dimensions) of the regular values of a column of mixed types."""
    out = []
    if wkt:
        head = heads(a)
        at = head.indices.to_numpy()
        valid = np.asarray(a.is_valid())
        for j, h in enumerate(head.dictionary.to_pylist()):
            parts = h.split()
            if parts and parts[0] in GeometryType.__members__ and parts[1:] in MARKS.values():
                out.append((np.flatnonzero(valid & (at == j)), int(GeometryType[parts[0]]), next(d for d, m in MARKS.items() if m == parts[1:])))
    else:
        data, off, valid = buffers(a)
        code = codes(data, off, valid)
        for c in np.unique(code[code > 0]).tolist():
            if c // 1000 < 4:
                out.append((np.flatnonzero(code == c), c % 1000, c // 1000 + 1))
    return [(rows, k, d) for rows, k, d in out if k in LEVEL]
