"""Suffix-array dedup: bytes covered by a 200-byte string that occurs elsewhere.

The index is a collection Burrows-Wheeler transform with common prefixes, built
column by column from the right: each round inserts one symbol for every
document of the collection, re-sorts the suffixes stably by that symbol and
updates the common prefixes of neighbours from those of the round before.
Neighbours that share ``length`` bytes are repeats.

One collection over a whole corpus would be inserted in as many rounds as its
longest document has bytes, each over all that was inserted before.  So the
collection is dealt out first, without losing a comparison:

* of the 32-byte strings in a window of ``length`` bytes, the one with the
  least hash (leftmost on ties) is the window's anchor.  It depends on the
  window's bytes only, so equal windows have equal anchors at equal offsets;
* maximal runs of windows with one anchor are segments of up to 368 bytes.
  Segments whose anchor occurs once are dropped, equal segments of one anchor
  are one segment with a count;
* the segments of an anchor are the documents of a small collection.  As equal
  windows lie at equal distances from the anchor, columns are aligned there,
  and a round compares suffixes of one column only: its cost is one symbol for
  each segment.  The sorted segments are a written table, read sequentially;
  many anchors share a bounded batch of it, whose columns (some 3 MB) are read
  in order from memory in place of a file each;
* an anchor with more than ``batch`` different segments (a passage that very
  many documents share, each with another text around it) is a collection too
  large for one task.  It is dealt out by the same principle once more: windows
  in one range of distances from the anchor make a piece, what all windows of
  the range have in common is the piece's anchor.  Ranges of 13 windows, and of
  one where that is not enough: a collection of equal windows.

Equal texts are one text with a count, equal segments one segment, known by 96
bits of their hashes besides the anchor's 64; all else is compared byte by byte
in the transform.

Defined cases: null text is empty; texts shorter than ``length`` lose nothing;
ids may be null or repeat, as only texts matter (each row counts as an
occurrence; equal rows cost one text and a count); an empty table gives an empty
result; very long texts are scanned in blocks that overlap by a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices, tidy, utf8, whole_groups
from .storage import drop_table, join_split, marked, read, splits, without, write_table

LENGTH, ANCHOR = 200, 32
BLOCK = 1 << 20
#: Different segments of an anchor that one batch takes; more are dealt out once again, in ranges of so many windows.
BATCH, WIDTHS = 1024, (13, 1)
_POS = np.uint64((1 << 22) - 1)
_M = 0x9E3779B97F4A7C15 | 1


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers and their inverses modulo 2**64."""
    inverse = pow(_M, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, _M, np.uint64)], dtype=np.uint64)
        down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, inverse, np.uint64)], dtype=np.uint64)
    return up, down


def segments(block: np.ndarray, up: np.ndarray, down: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Of a block: first window, number of windows, anchor offset and anchor hash of each segment."""
    m = len(block)
    grams, width = m - anchor + 1, length - anchor + 1
    windows = grams - width + 1
    sums = np.zeros(m + 1, np.uint64)
    np.cumsum((block + np.uint64(1)) * up[:m], out=sums[1:])
    h = (sums[anchor:] - sums[:-anchor]) * down[:grams]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    rows = -(-grams // width)
    key = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    np.bitwise_or(h & ~_POS, np.arange(grams, dtype=np.uint64), out=key[:grams])
    key = key.reshape(rows, width)
    ahead = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
    back = np.minimum.accumulate(key, axis=1).ravel()
    at = (np.minimum(ahead[:windows], back[width - 1 : width - 1 + windows]) & _POS).astype(np.int64)
    first = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1]
    count = np.diff(np.r_[first, windows])
    return first, count, at[first] - first, h[at[first]]


def all_segments(docs: DataFrame, length: int) -> DataFrame:
    """(h, c, k, th, tc, p): anchor hash, 96 bits of the content's hash, text and packed place of every segment.

    p = first window << 16 | anchor offset << 8 | windows - 1.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, down = powers(BLOCK + length)
        for b in slices(batches):
            texts = utf8(b.column(2))
            out: list[tuple[np.ndarray, ...]] = []
            rows: list[int] = []
            held = 0

            def flush() -> pa.RecordBatch:
                take = pa.array(np.repeat(rows, [len(o[0]) for o in out]))
                h, c, k, p = (pa.array(np.concatenate([o[j] for o in out])) for j in range(4))
                return pa.RecordBatch.from_arrays([h, c, k, b.column(0).take(take), b.column(1).take(take), p], ["h", "c", "k", "th", "tc", "p"])

            for i, t in enumerate(texts):
                for s in range(0, len(t) - length + 1, BLOCK):
                    part = t[s : s + BLOCK + length - 1]
                    first, count, off, h = segments(np.frombuffer(part, np.uint8), up, down, length)
                    ends = (first + count + (length - 1)).tolist()
                    c, k = content([part[x:y] for x, y in zip(first.tolist(), ends)])
                    out.append((h.view(np.int64), c, k, (first + s) << 16 | off << 8 | count - 1))
                    rows.append(i)
                    held += len(h)
                if held > 20_000:
                    yield flush()
                    out, rows, held = [], [], 0
            if held:
                yield flush()

    return docs.select("__th", "__tc", "__text").mapInArrow(run, "h long, c long, k int, th long, tc int, p long")


def content(parts: list[bytes], seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of each part's hash, as a long and an int."""
    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x, seed) for x in parts]), "<i8").reshape(-1, 2)
    return both[:, 0].copy(), (both[:, 1] >> 32).astype(np.int32)


def shared_windows(texts: list[bytes], left: np.ndarray, group: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of each text occur in another text of its group.

    ``texts``: sorted by ``group`` (dense numbers under 65,536); ``left``: bytes
    before the aligned column.  Returns a boolean matrix, texts by columns; a
    text's first byte is at column max(left) - left.
    """
    n = len(texts)
    lens = np.fromiter(map(len, texts), np.int64, n)
    lead = int(left.max())
    width = lead + int((lens - left).max())
    columns = np.zeros((width, n), np.uint16)  # 0: no symbol of the text in this column
    for i, (t, at) in enumerate(zip(texts, (lead - left).tolist())):
        columns[at : at + len(t), i] = np.frombuffer(t, np.uint8)
        columns[at : at + len(t), i] += 1
    group = group.astype(np.uint16)
    fresh = group[1:] != group[:-1]
    order, prefix = np.arange(n), np.zeros(n + 1, np.int32)  # suffixes in order; common prefix with the one before
    found = np.zeros((width, n), bool)
    for c in range(width - 1, -1, -1):
        bwt = columns[c][order]  # the symbols before the suffixes, in their order
        p = np.argsort(bwt, kind="stable")
        p = p[np.argsort(group[p], kind="stable")]  # groups keep their places
        order, symbol = order[p], bwt[p]
        pair = np.flatnonzero((symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & ~fresh)
        lo, hi = p[pair], p[pair + 1]
        common = prefix[hi]
        far = np.flatnonzero(hi > lo + 1)
        if len(far):
            ends = np.empty(2 * len(far), np.int64)
            ends[0::2], ends[1::2] = lo[far] + 1, hi[far] + 1
            common[far] = np.minimum.reduceat(prefix, ends)[0::2]
        prefix = np.zeros(n + 1, np.int32)
        prefix[pair + 1] = common + 1
        repeat = prefix >= length
        found[c, order[repeat[:-1] | repeat[1:]]] = True
    return found.T


def repeated(candidates: DataFrame, length: int) -> DataFrame:
    """(h, c, k, ranges): runs of repeated windows in each segment, as (first, last) pairs of shorts."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["h"], 4_000):
            h = t.column("h").to_numpy()
            n = t.column("n").to_numpy()
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
            several = np.repeat(np.add.reduceat(n, first) > 1, np.diff(np.r_[first, len(h)]))
            t, h, n = t.filter(pa.array(several)), h[several], np.minimum(n[several], 2)  # two copies stand for any number
            if not len(h):
                continue
            group = np.cumsum(np.r_[False, h[1:] != h[:-1]])
            off = t.column("off").to_numpy()
            texts = t.column("bytes").to_pylist()
            twice = np.repeat(np.arange(len(texts)), n)
            found = shared_windows([texts[i] for i in twice], off[twice], group[twice], length)
            found = found[np.searchsorted(twice, np.arange(len(texts)))]
            lead = int(off.max())
            edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (r1, a), (r2, b) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            pairs = np.empty((len(a), 2), "<i2")
            pairs[:, 0], pairs[:, 1] = a - (lead - off[r1]), b - 1 - (lead - off[r2])
            cuts = np.searchsorted(r1, np.arange(len(texts) + 1))
            some = np.flatnonzero(cuts[1:] > cuts[:-1])
            out = [pairs[cuts[i] : cuts[i + 1]].tobytes() for i in some]
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([t.column(x).take(at).combine_chunks() for x in ("h", "c", "k")] + [pa.array(out, pa.binary())], ["h", "c", "k", "ranges"])

    narrow = candidates.select("h", "c", "k", "n", "off", "bytes")
    return narrow.repartition("h").sortWithinPartitions("h").mapInArrow(run, "h long, c long, k int, ranges binary")


def dealt(large: DataFrame, length: int, width: int) -> DataFrame:
    """Segments of anchors with very many, cut into pieces of up to ``width`` windows.

    (ph, pc, pk, at, n, h, c, k, off, bytes): the segment, the piece's first
    window in it, and the piece as a segment of a collection of its own.  Windows
    at one distance from the anchor fall into one piece everywhere, and what all
    windows of such a range have in common is the new anchor: equal windows have
    equal ones, at equal distances.
    """

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            rows, at, off, parts, cores = [], [], [], [], []
            for i, (t, o) in enumerate(zip(b.column(5).to_pylist(), b.column(4).to_pylist())):
                last = len(t) - length  # windows 0..last, window j at j - o from the anchor
                for q in range(-o // width, (last - o) // width + 1):
                    j0, j1 = max(0, q * width + o), min(last, (q + 1) * width - 1 + o)
                    rows.append(i)
                    at.append(j0)
                    core = q * width + width - 1 + o
                    off.append(core - j0)
                    parts.append(t[j0 : j1 + length])
                    cores.append(t[core : core + length - width + 1] + q.to_bytes(2, "little", signed=True))
            c, k = (np.array([x[0] for x in y]) for y in zip(*[content([x], o) for x, o in zip(parts, off)]))  # equal pieces at another distance are others
            anchor = content(cores, width)[0] ^ (b.column(0).to_numpy()[rows] * 3)
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(x).take(take) for x in range(3)] + [pa.array(np.array(at, np.int32)), b.column(3).take(take), pa.array(anchor), pa.array(c), pa.array(k), pa.array(np.array(off, np.int32)), pa.array(parts, pa.binary())],
                ["ph", "pc", "pk", "at", "n", "h", "c", "k", "off", "bytes"],
            )

    return large.select("h", "c", "k", "n", "off", "bytes").mapInArrow(run, "ph long, pc long, pk int, at int, n long, h long, c long, k int, off int, bytes binary")


def regathered(pieces: DataFrame, marks: DataFrame) -> DataFrame:
    """The marks of segments from those of their pieces."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [np.concatenate([np.frombuffer(m["ranges"], "<i2") + np.int16(m["at"]) for m in ms]).astype("<i2").tobytes() for ms in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.binary())], ["h", "c", "k", "ranges"])

    back = pieces.drop("bytes").join(marks, ["h", "c", "k"])
    by = back.groupBy("ph", "pc", "pk").agg(F.collect_list(F.struct("at", "ranges")).alias("m"))  # a segment has few pieces
    return by.mapInArrow(run, "h long, c long, k int, ranges binary")


def marks_of(segs: DataFrame, length: int, batch: int, scratch: list[DataFrame], parts: int, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """(h, c, k, ranges) of different segments (h, c, k, n, off, bytes) with their counts, any number to an anchor."""
    if not widths:
        return repeated(segs, length)
    large = write_table(segs.groupBy("h").agg(F.count("*").alias("size")).filter(F.col("size") > batch).select("h"), "op9-large", scratch, parts)
    found = repeated(segs.join(large, "h", "left_anti"), length)
    if large.isEmpty():
        return found
    pieces = write_table(dealt(segs.join(large, "h", "left_semi"), length, min(widths[0], length)), "op9-pieces", scratch, parts)
    # rows of one key are equal in off and bytes
    different = pieces.groupBy("h", "c", "k").agg(F.sum("n").alias("n"), F.first("off").alias("off"), F.first("bytes").alias("bytes"))
    return found.unionByName(regathered(pieces, marks_of(different, length, batch, scratch, parts, widths[1:])))


def keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.withColumns({"__th": F.xxhash64(text), "__tc": (F.crc32(text.cast("binary")) - F.lit(1 << 31)).cast("int"), "__text": text})


def removed_spans(docs: DataFrame, length: int = LENGTH, batch: int = BATCH) -> DataFrame:
    """(__th, __tc, marks): repeated windows of each different text of :func:`keyed`, by segment; a written table.
    """
    scratch: list[DataFrame] = []
    found = write_table(all_segments(docs, length), "op9-segments")
    parts = splits(found)
    often = found.groupBy("h").agg(F.count("*").alias("__n")).filter("__n > 1").select("h")
    # a row for each different place: rows of one text are counted
    key = ["h", "c", "k", "th", "tc", "p"]
    places = write_table(join_split(found, often, ["h"]).groupBy(*key).agg(F.count("*").alias("n")), "op9-places", scratch, parts)
    drop_table(found)
    # one row for each different segment, from one place where it stands
    different = places.groupBy("h", "c", "k").agg(F.sum("n").alias("n"), F.min(F.struct("th", "tc", "p")).alias("w"))
    wanted = different.select("h", "c", "k", "n", "w.th", "w.tc", "w.p")
    # ask each text once; the list is bounded by its length
    asked = wanted.groupBy("th", "tc").agg(F.collect_list(F.struct("h", "c", "k", "n", "p")).alias("ask"))
    asked = write_table(asked, "op9-asked", scratch, parts)
    rows = marked(docs.select(F.col("__th").alias("th"), F.col("__tc").alias("tc"), F.col("__text").alias("t")), "th", asked.select("th")).filter("__may")
    given = rows.groupBy("th", "tc").agg(F.first("t").alias("t"))  # equal texts: any is the same
    first = F.expr("cast(shiftright(a.p, 16) as int)")
    got = given.join(asked, ["th", "tc"]).select(F.col("t").cast("binary").alias("t"), F.explode("ask").alias("a"))
    got = got.select("a.h", "a.c", "a.k", "a.n", F.expr("cast(shiftright(a.p, 8) & 255 as int)").alias("off"), F.substring(F.col("t"), first + 1, F.expr(f"cast((a.p & 255) + {length} as int)")).alias("bytes"))
    got = write_table(got, "op9-bytes", scratch, parts)
    marks = marks_of(got, length, batch, scratch, parts)
    by_text = places.join(marks, ["h", "c", "k"]).groupBy("th", "tc").agg(F.collect_list(F.struct("p", "ranges")).alias("marks"))
    out = write_table(by_text.select(F.col("th").alias("__th"), F.col("tc").alias("__tc"), "marks"), "op9-spans", parts=parts)
    drop_table(*scratch)
    return out


def dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, batch: int = BATCH, as_text: bool = False, with_text: bool = True) -> DataFrame:
    """``docs`` with kept (the remaining bytes), spans (removed runs, start and end) and n_bytes.

    ``as_text``: kept as a string; characters that a cut has split are left out.  ``with_text``: if false,
    the text column itself is left behind, and each text passes through once.
    """
    rows = keyed(without(docs, "kept", "spans", "n_bytes"), text_col)
    marks = removed_spans(rows, length, batch)
    carried = [c for c in rows.columns if not c.startswith("__") and (with_text or c != text_col)]
    # only texts that may lose something are moved
    split = marked(rows, "__th", marks.select("__th"))
    touched = split.filter("__may").join(marks, ["__th", "__tc"], "left")
    joined = touched.unionByName(split.filter("not __may").withColumn("marks", F.lit(None).cast(marks.schema["marks"].dataType))).select(*[F.col(f"`{c}`") for c in carried], F.col("__text"), F.col("marks.p").alias("__p"), F.col("marks.ranges").alias("__r"))
    schema = rows.select(*[F.col(f"`{c}`") for c in carried]).schema
    out = T.StructType([*schema.fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("n_bytes", T.LongType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(carried)
        for b in slices(batches):
            kept, starts, ends, offsets, sizes = [], [], [], [0], []
            for t, p, r in zip(utf8(b.column(n)), b.column(n + 1).to_pylist(), b.column(n + 2).to_pylist()):
                a, e = spans_of(p, r, length) if p else ([], [])
                last, parts = 0, []
                for x, y in zip(a, e):
                    parts.append(t[last:x])
                    last = y
                kept.append(b"".join([*parts, t[last:]]) if a else t)
                starts += a
                ends += e
                offsets.append(len(starts))
                sizes.append(len(t))
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["start", "end"]))
            column = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:n], column, spans, pa.array(sizes, pa.int64())], [*carried, "kept", "spans", "n_bytes"])

    return joined.mapInArrow(run, out)


def spans_of(places: list[int], ranges: list[bytes], length: int) -> tuple[list[int], list[int]]:
    """Maximal runs covered by the marked windows."""
    pairs = [np.frombuffer(r, "<i2").reshape(-1, 2).astype(np.int64) + (p >> 16) for p, r in zip(places, ranges)]
    m = np.concatenate(pairs)
    m = m[np.argsort(m[:, 0], kind="stable")]
    end = np.maximum.accumulate(m[:, 1] + length)
    new = np.r_[True, m[1:, 0] > end[:-1]]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(m) - 1]
    return m[new, 0].tolist(), end[last].tolist()


def drop_repeated_passages(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of the texts; every row stays, n_chars (if there) follows."""
    out = dedup(docs, text_col, length, as_text=True, with_text=False)
    new = {text_col: F.col("kept")} | ({"n_chars": F.char_length("kept").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.withColumns(new).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_columns(docs: DataFrame) -> DataFrame:
    out = dedup(docs.select("doc_id", "text"), with_text=False)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x.end - x.start)
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_columns(read(spark, sf_dir, "documents"))
