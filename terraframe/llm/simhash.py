"""SimHash near-duplicates by the generalised pigeonhole principle.

1. A fingerprint per document: bit i is set if more than half of the document's
   shingle hashes (XXH64, seed 42, 4-word shingles with repeats) have it set.
2. Equal fingerprints are one vertex from here on, so a group of copies weighs
   as one row.
3. The 64 bits are grouped: bits that correlate over all fingerprints go into
   the same partition.  For m partitions, thresholds t_1..t_m >= -1 with
   sum(t_i) = distance - m + 1 guarantee that two fingerprints within
   ``distance`` differ by at most t_i bits in some partition i (otherwise they
   would differ by sum(t_i + 1) = distance + 1).  A dynamic program picks
   unequal thresholds that minimise estimated probes and candidates; the
   estimates come from counts over all fingerprints, and the best m is taken.
4. Probe and verify: a fingerprint goes to the bucket of its own bits in each
   partition and, for t_i > 0, to those of all flips of up to t_i bits.  A
   bucket's members are verified with XOR and bit counts; it returns a spanning
   forest of its links, never its pairs.  A bucket above ``chunk`` members is
   split by pigeonhole on its other bits, again and again, and what agrees in all of
   them into cells of chunk pairs, so that many tasks meet all its pairs between them.
5. Components of the forests, distributed (see components).

Defined cases: null or wordless text has fingerprint zero and links like any
other; a null id never becomes a component's id unless the whole component has
none; repeated rows get the same answer; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import groups, slices, tidy, utf8
from .components import connected
from .minhash import DRAWN, drawn_columns, drawn_from, joined
from .shingles import hashes
from .storage import drop_table, join_split, read, splits, without_rows, write_table

BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    return voted(hashes(text, shingle))


def voted(parts: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have set."""
    counts, n = np.zeros(BITS, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, banded: bool = False) -> DataFrame:
    """(id, th, fp): the text's hash and its fingerprint as signed 64-bit numbers; with MinHash keys and sketches if ``banded``."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp, own = [], []
            for t in utf8(b.column(2)):
                parts = hashes(t, shingle)
                if banded:
                    parts = list(parts)
                    own.append(drawn_from(parts))
                fp.append(voted(parts))
            out = [b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out + (drawn_columns(own) if banded else []), ["id", "th", "fp"] + ["n", "bands", "sketch"] * banded)

    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return narrow.mapInArrow(run, "id long, th long, fp long" + f", {DRAWN}" * banded)


# -- planning ---------------------------------------------------------------


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows, and the 64 x 64 co-occurrence counts, over all of ``fps``; summed by Spark."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS), np.int64), 0
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(v, axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            n += len(bits)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, np.arange(BITS * BITS)]), pa.array(np.r_[n, total.ravel()])], ["cell", "n"])

    out, n = np.zeros(BITS * BITS, np.int64), 0
    for r in fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # 4097 rows
        if r[0] < 0:
            n = r[1]
        else:
            out[r[0]] = r[1]
    return n, out.reshape(BITS, BITS)


def grouped_bits(n: int, together: np.ndarray, m: int) -> list[list[int]]:
    """Deal the bits into m partitions of near equal width, correlated bits together."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(m):
        width = (BITS - sum(map(len, out))) // (m - i)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            best = max(left, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def mask_of(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def estimated(n: int, together: np.ndarray, bits: list[int], t: int, same: float) -> float:
    """Candidates within t flips in a partition: measured collisions times the odds of each flip."""
    p = np.clip(np.diag(together)[bits] / max(n, 1), 1e-6, 1 - 1e-6)
    odds = 2 * p * (1 - p) / (1 - 2 * p * (1 - p))
    poly = [1.0] + [0.0] * t
    for o in odds:
        for j in range(t, 0, -1):
            poly[j] += poly[j - 1] * o
    return same * sum(poly)


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with the given sum and least cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for s, (v, ts) in best.items():
            for t in range(-1, len(c) - 1):
                if s + t not in step or v + c[t + 1] < step[s + t][0]:
                    step[s + t] = (v + c[t + 1], [*ts, t])
        best = step
    return best[total]


def plan(fps: DataFrame, distance: int, probe_cost: float = 1.0, verify_cost: float = 0.01) -> list[tuple[list[int], int]]:
    """Partitions of the bits with their thresholds."""
    n, together = bit_statistics(fps)
    ways = {m: grouped_bits(n, together, m) for m in range(2, distance + 2)}
    parts = [(m, i, bits) for m, w in ways.items() for i, bits in enumerate(w)]
    keys = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("fp").bitwiseAND(F.lit(signed(mask_of(b)))).alias("v")) for j, (_, _, b) in enumerate(parts)]))
    same = fps.select(keys.alias("k")).groupBy("k.j", "k.v").count().groupBy("j").agg(F.sum(F.col("count").cast("double") * F.col("count"))).collect()
    same = {r[0]: r[1] for r in same}
    found = []
    for m, w in ways.items():
        costs = []
        for i, bits in enumerate(w):
            j = parts.index((m, i, bits))
            row = [0.0]
            for t in range(max(0, distance - m + 2)):
                probes = sum(math.comb(len(bits), k) for k in range(t + 1))
                row.append(n * probes * probe_cost + estimated(n, together, bits, t, same.get(j, 0.0)) * verify_cost)
            costs.append(row)
        cost, ts = allocate(costs, distance - m + 1)
        found.append((cost, -m, [(b, t) for b, t in zip(w, ts) if t >= 0]))
    return min(found)[2]  # of equal costs the one with most partitions, which flips least


# -- probing ----------------------------------------------------------------


def flips(bits: list[int], t: int) -> list[int]:
    out, level = [0], [(0, -1)]
    for _ in range(t):
        level = [(v | 1 << b, i) for v, last in level for i, b in enumerate(bits) if i > last]
        out += [v for v, _ in level]
    return out


def signatures(parts: list[tuple[list[int], int]]) -> Column:
    """Explode a fingerprint into its buckets: (part, value)."""

    def buckets(i: int, bits: list[int], t: int) -> Column:
        own = F.col("fp").bitwiseAND(F.lit(signed(mask_of(bits))))
        flipped = F.array(*[F.lit(signed(f)) for f in flips(bits, t)])  # folded to one literal
        return F.transform(flipped, lambda f: F.struct(F.lit(i).alias("part"), own.bitwiseXOR(f).alias("value")))

    return F.explode(F.flatten(F.array(*[buckets(i, bits, t) for i, (bits, t) in enumerate(parts)])))


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints (unsigned: bit counts are of magnitudes)."""
    none = np.zeros(0, fp.dtype)
    if len(fp) < 2:
        return none, none
    if len(fp) <= 128:
        near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= distance
        if near.sum() == len(fp):
            return none, none
    rest, a, b = np.ones(len(fp), bool), [], []
    for seed in range(len(fp)):
        if not rest[seed]:
            continue
        rest[seed] = False
        stack = [seed]
        while stack:
            at = stack.pop()
            open_ = np.flatnonzero(rest)
            hit = open_[np.bitwise_count(fp[open_] ^ fp[at]) <= distance]
            if len(hit):
                rest[hit] = False
                a += hit.tolist()
                b += [seed] * len(hit)
                stack += hit.tolist()
    return fp[a], fp[b]


#: How often a large bucket is split by its other bits.
LEVELS = 3


def split_masks(bits: list[int], distance: int) -> list[dict[int, list[int]]]:
    """For each level the masks by which the buckets of a path are split: of the bits that its path has not used, in groups.

    A path is the groups taken so far, in digits of base 8.
    """
    out: list[dict[int, list[int]]] = []
    open_ = {0: [b for b in range(BITS) if b not in bits]}
    for _ in range(LEVELS):
        groups = {path: [rest[k :: distance + 1] for k in range(distance + 1)] for path, rest in open_.items()}
        out.append({path: [mask_of(g) for g in gs] for path, gs in groups.items()})
        open_ = {path * 8 + k + 1: [b for b in rest if b not in groups[path][k]] for path, rest in open_.items() for k in range(distance + 1)}
    return out


def split_buckets(members: DataFrame, parts: list[tuple[list[int], int]], distance: int, chunk: int) -> DataFrame:
    """Large buckets once more by pigeonhole: members within ``distance`` agree in one of distance + 1 groups of the other bits.

    What is large still is split by the bits that are left, ``LEVELS`` times; what agrees in all these groups, and so nearly
    everywhere, is dealt into cells of chunk pairs.
    """
    masks = [split_masks(bits, distance) for bits, _ in parts]
    keys, done = ["part", "value", "sub", "rest"], None
    now = members.select("part", "value", F.lit(0).alias("sub"), F.lit(0).cast("long").alias("used"), "fp")
    for level in range(LEVELS):
        by_path = F.create_map(*[x for i, own in enumerate(masks) for path, ms in own[level].items() for x in (F.lit(i * 8**LEVELS + path), F.array(*[F.lit(signed(m)) for m in ms]))])
        split = now.select("part", "value", "sub", "used", "fp", F.posexplode(by_path[F.col("part") * 8**LEVELS + F.col("sub")]).alias("k", "mask"))
        used = F.col("used").bitwiseOR(F.col("mask"))
        split = split.select("part", "value", (F.col("sub") * 8 + F.col("k") + 1).alias("sub"), used.alias("used"), F.col("fp").bitwiseAND(used).alias("rest"), "fp")
        sizes = split.groupBy(*keys).agg(F.count("*").alias("size")).filter("size > 1")
        last = level + 1 == LEVELS
        found = split.join(sizes if last else sizes.filter(F.col("size") <= chunk), keys)
        k = F.ceil(F.col("size") / F.lit(chunk)).cast("int")
        own = F.pmod(F.xxhash64("fp"), k).cast("int")
        cells = F.explode(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.struct(F.least(i, own).alias("ci"), F.greatest(i, own).alias("cj"))))
        found = found.select(*keys, "fp", cells.alias("c")).select(*keys, "c.ci", "c.cj", "fp")
        done = found if done is None else done.unionByName(found)
        large = sizes.filter(F.col("size") > chunk).select(*keys)
        if last or large.isEmpty():
            return done
        now = split.join(large, keys).select("part", "value", "sub", "used", "fp")
    return done


def links(fps: DataFrame, distance: int = 4, chunk: int = 2048, scratch: list[DataFrame] | None = None, files: int | None = None) -> DataFrame:
    """Spanning-forest edges (a, b) of all links among distinct ``fps``, bucket by bucket."""
    parts = plan(fps, distance)
    sig = fps.select("fp", signatures(parts).alias("s")).select("fp", "s.part", "s.value")
    bucket, keys = ["part", "value"], ["part", "value", "sub", "rest", "ci", "cj"]
    sizes = write_table(sig.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1"), "op1-sizes", scratch, files)
    large = sizes.filter(F.col("size") > chunk).select(*bucket)
    zero = F.lit(0).cast("long")
    cells = sig.join(sizes.filter(F.col("size") <= chunk), bucket).select(*bucket, F.lit(-1).alias("sub"), zero.alias("rest"), F.lit(0).alias("ci"), F.lit(0).alias("cj"), "fp")
    if not large.isEmpty():
        cells = cells.unionByName(split_buckets(sig.join(large, bucket), parts, distance, chunk))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, held = [], [], 0
        for g in groups(batches, keys):
            if g.num_rows > 1:
                a, b = forest(np.unique(g.column("fp").to_numpy()).view(np.uint64), distance)
                if len(a):
                    out_a.append(a.view(np.int64))
                    out_b.append(b.view(np.int64))
                    held += len(a)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


# -- similarity -------------------------------------------------------------


def merged(docs: DataFrame, found: DataFrame, text_col: str, shingle: int, similarity: float, parts: int | None = None) -> DataFrame:
    """(th, root) for every text, where groups with a pair of texts of that similarity are one (see minhash); a written table."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    firsts = [F.first(c).alias(c) for c in ("root", "n", "bands", "sketch")]
    own = write_table(found.groupBy("th").agg(*firsts), "op1-texts", parts=parts)
    roots = joined(own, texts, shingle, round(100 * similarity), "op1-similar", parts)
    drop_table(own)
    return roots


def grouped(docs: DataFrame, id_col: str, text_col: str, distance: int, shingle: int, banded: bool = False, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(id, th, fp, component_id, root) for every row of ``docs``; root numbers the components; with MinHash columns if ``banded``."""
    rows = write_table(fingerprints(docs, id_col, text_col, shingle, banded), "op1-fingerprints", scratch)
    parts = splits(rows)
    fps = write_table(rows.groupBy("fp").agg(F.min("id").alias("first")), "op1-distinct", parts=parts)
    own_scratch: list[DataFrame] = [fps]
    roots = connected(links(fps.select("fp"), distance, scratch=own_scratch, files=parts), "op1-components", parts=parts)
    labelled = fps.join(roots, fps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    own = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = write_table(join_split(labelled.select("fp", "root"), own, ["root"]).select("fp", "root", "component_id"), "op1-labels", scratch, parts)
    drop_table(*own_scratch, roots)
    return rows.join(by_fp, "fp").select("id", "th", "fp", "component_id", "root", *["n", "bands", "sketch"] * banded)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``."""
    found = grouped(docs, id_col, text_col, distance, shingle)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row for each component: that of the smallest id (null last), then of the smallest text hash.

    With ``similarity``, texts of that Jaccard similarity of their shingles are one component as well: 64 bits
    can't tell them from others (at 0.8 they differ in about ten), so candidates come from MinHash bands and
    are verified on the whole sets of shingles.
    """
    scratch: list[DataFrame] = []
    found = grouped(docs, id_col, text_col, distance, shingle, similarity is not None, scratch)
    if similarity is not None:
        roots = merged(docs, found, text_col, shingle, similarity, splits(scratch[0]))
        scratch.append(roots)
        found = found.select("id", "th").join(roots, "th")
    parts = splits(scratch[0])
    per = write_table(found.groupBy("root", "id", "th").agg(F.count("*").alias("n")), "op1-rows", scratch, parts)
    rank = F.struct(F.col("id").isNull(), "id", "th")
    first = per.groupBy("root").agg(F.min_by(F.struct("id", "th", "n"), rank).alias("f")).select("f.*")
    first = write_table(first.select(F.col("id").alias("__fid"), F.col("th").alias("__fth"), "n"), "op1-first", scratch, parts)
    same = F.col("id").eqNullSafe(F.col("__fid")) & (F.col("th") == F.col("__fth"))
    gone = per.join(first, same, "left_anti").select(F.col("id").alias("__oid"), F.col("th").alias("__oth"))
    equal = first.filter("n > 1").select(F.col("__fid").alias("__oid"), F.col("__fth").alias("__oth"))
    # the few that go, not the many that stay: while they are small enough to broadcast, no text is moved
    text = F.col(f"`{text_col}`")
    once = without_rows(docs, write_table(gone.union(equal), "op1-dropped", parts=parts), id_col, text)
    if equal.isEmpty():
        kept = once
    else:  # of rows equal in id and text one stays
        equal = write_table(equal, "op1-equal", parts=parts)
        hashed = docs.withColumn("__th", F.xxhash64(text.cast("string")))
        more = hashed.join(equal, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__oid")) & (F.col("__th") == F.col("__oth")), "left_semi")
        kept = once.unionByName(more.dropDuplicates([id_col, "__th"]).drop("__th"))
    drop_table(*scratch)
    return kept


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
