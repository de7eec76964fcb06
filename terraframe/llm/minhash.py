"""MinHash near-duplicates with odd sketches.

1. A text's set is that of its shingles' hashes (XXH64, seed 42).  Of each
   different text come ``BANDS`` x ``ROWS`` MinHash samples: ``BANDS`` keys of
   ``ROWS`` samples each, and the odd sketch, a bitmap in which every sample flips
   one bit.  Of two bitmaps the XOR's population count c tells how many samples
   differ, and so the similarity, J = 1 + bits / (4 * samples) * ln(1 - 2 c / bits),
   the more precisely the higher it is.
2. Texts that share a band's key are a bucket.  Buckets of the same members (most
   of them: near copies agree in many bands) are one.
3. A bucket above ``CHUNK`` texts first meets its hubs: texts that are similar to
   a hub, on their sets, are of its group.  This only saves work.
4. What then is in different groups of a bucket is compared completely.  A bucket
   is one cell, a larger one is dealt into cells of two chunks each, so that every
   two members of different groups meet in a cell; the largest group never meets
   itself.  A cell compares the sketches, and gives the texts of each component of
   what may be similar; these are compared once more on their whole sets, by which
   alone texts are linked.  Neither pairs nor groups are ever rows by the square.
5. Components of the links, distributed (see components).

What is lost: a pair of exactly the asked similarity shares no band with a
probability of (1 - s^ROWS)^BANDS, 3e-7 at 0.85 and 6e-5 at 0.8, and its sketches differ
too much with one of some 1e-6; more similar ones with less.  Texts, shingles and keys
are known by 64 bits.  Nothing depends on the size of a bucket.

Defined cases: a text without words (or null) has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; a
null id stands for a component only if no other is there, and counts as kept if
it does; equal rows get equal answers; an empty table gives an empty result; only
id and text are read, of other columns nothing clashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import groups, slices, tidy, utf8
from .components import connected
from .shingles import hashes
from .storage import drop_table, join_split, marked, read, splits, write_table

BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch.
SKETCH = 1024
#: A cell's chunk: so many texts, and shingles in them, or so.
CHUNK, WEIGHT = 1024, 1 << 20
#: Rounds in which large buckets meet their hubs, before they are compared completely.
HUB_ROUNDS = 4

_RNG = np.random.default_rng(13)
_FACTORS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# -- one text ---------------------------------------------------------------


def samples(found: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes that is not empty."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[None, at : at + 512] * _FACTORS[:, None]).min(axis=1), out=least)
    return (least ^ least >> np.uint64(29)) * _MIX + _SALTS


def band_keys(drawn: np.ndarray) -> np.ndarray:
    """A key for each band; bands differ in their salts, so one number is enough."""
    keys = (drawn.reshape(BANDS, ROWS) * _FACTORS[:ROWS]).sum(axis=1, dtype=np.uint64)
    return ((keys ^ keys >> np.uint64(31)) * _MIX).view(np.int64)


def odd_sketch(drawn: np.ndarray) -> bytes:
    """A bitmap of the bits that an odd number of samples chose."""
    bits = ((drawn ^ drawn >> np.uint64(32)) * _MIX >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(bits, minlength=SKETCH) & 1, bitorder="little").tobytes()


def estimated(differing: int | np.ndarray) -> float | np.ndarray:
    """The similarity that so many differing bits of two sketches tell; 0 or less where they tell nothing."""
    return 1 + SKETCH / (4 * SAMPLES) * np.log(np.maximum(1 - 2 * np.asarray(differing) / SKETCH, 1e-9))


def most_differing(percent: int) -> int:
    """Texts of that similarity differ in no more bits of their sketches, but for one of some million pairs."""
    s = percent / 100
    samples_off = SAMPLES * (1 - s) + 5 * math.sqrt(SAMPLES * s * (1 - s))
    bits = SKETCH / 2 * (1 - (1 - 2 / SKETCH) ** (2 * samples_off))
    return math.ceil(bits + 3 * math.sqrt(bits))


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def drawn_from(parts: list[np.ndarray]) -> tuple[int, np.ndarray | None, bytes]:
    """Of a text's hashes: the size of its set, its band keys, its odd sketch."""
    found = distinct(parts)
    if not len(found):
        return 0, None, b""
    drawn = samples(found)
    return len(found), band_keys(drawn), odd_sketch(drawn)


#: Columns that :func:`drawn_from` gives.
DRAWN = "n long, bands array<long>, sketch binary"


def drawn_columns(drawn: list[tuple[int, np.ndarray | None, bytes]]) -> list[pa.Array]:
    n, bands, sketch = zip(*drawn) if drawn else ((), (), ())
    return [pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]


# -- comparing --------------------------------------------------------------


def alike(th: np.ndarray, root: np.ndarray, n: np.ndarray, sketch: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """The components, as places, of the texts of different roots that may be similar by sizes and sketches."""
    most, rest = most_differing(percent), np.ones(len(th), bool)
    for seed in range(len(th)):
        if not rest[seed]:
            continue
        rest[seed] = False
        found, stack = [seed], [seed]
        while stack:
            at = stack.pop()
            open_ = np.flatnonzero(rest & (root != root[at]) & (100 * n >= percent * n[at]) & (100 * n[at] >= percent * n))
            if len(open_):
                hit = open_[np.bitwise_count(sketch[open_] ^ sketch[at]).sum(axis=1, dtype=np.int64) <= most]
                rest[hit] = False
                found += hit.tolist()
                stack += hit.tolist()
        if len(found) > 1:
            yield np.array(found)


def similar_roots(sets: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges between roots: a spanning forest of all pairs of ``sets`` of that similarity, those of a root being one."""
    size = np.array([len(s) for s in sets])
    starts = np.cumsum(size) - size
    place = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marks, rest, edges = np.zeros(int(place.max()) + 1, bool), np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        if not rest[seed]:
            continue
        rest[seed] = False
        stack = [seed]
        while stack and rest.any():
            at = stack.pop()
            own = place[starts[at] : starts[at] + size[at]]
            marks[own] = True
            both = np.add.reduceat(marks[place], starts, dtype=np.int64)
            marks[own] = False
            near = rest & (100 * both >= percent * (size + size[at] - both))
            edges += [(int(root[at]), int(r)) for r in np.unique(root[near]) if r != root[at]]
            hit = np.flatnonzero(near | rest & (root == root[at]))
            rest[hit] = False
            stack += hit.tolist()
    return edges


def shingle_sets(asked: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(th, s): the sets of shingle hashes of the texts whose hash is in ``asked`` (and of some more); texts: th, text."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            th = b.column(0).to_numpy(zero_copy_only=False)
            picked = b.take(pa.array(np.unique(th, return_index=True)[1]))
            sets = [distinct(list(hashes(t, shingle))).tobytes() for t in utf8(picked.column(1))]
            yield pa.RecordBatch.from_arrays([picked.column(0), pa.array(sets, pa.binary())], ["th", "s"])

    some = marked(texts, "th", asked).filter("__may").select("th", "text")
    return some.mapInArrow(run, "th long, s binary").groupBy("th").agg(F.first("s").alias("s"))  # equal texts have equal sets


# -- buckets ----------------------------------------------------------------


def open_buckets(members: DataFrame) -> DataFrame:
    """(key, size, weight): the buckets with members of different roots, one of those that have the same members."""
    found = members.groupBy("key").agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("th").alias("lo"), F.max("th").alias("hi"), F.bit_xor(F.xxhash64("th")).alias("x"))
    return found.filter("r0 <> r1").groupBy("size", "lo", "hi", "x").agg(F.min(F.struct("key", "weight")).alias("b")).select("b.key", "size", "b.weight")


def is_large(size: str = "size", weight: str = "weight") -> Column:
    return (F.col(size) > CHUNK) | (F.col(weight) > WEIGHT)


def hub_pairs(members: DataFrame, salt: int) -> DataFrame:
    """(a, b, ra, rb): every member of a bucket with two of them, in order, with their roots.

    The one hub is the text that meets most others in all bands, so the middle of
    a group of copies; the other one is drawn, another in each bucket and round.
    """
    own = F.struct("th", "root")
    hubs = members.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.array(F.max_by(own, F.struct("meets", "th")), F.min_by(own, F.xxhash64("root", "key", F.lit(salt)))).alias("hubs"))
    met = join_split(members, hubs.filter("r0 <> r1").select("key", "hubs"), ["key"]).select("th", "root", F.explode("hubs").alias("h")).filter("root <> h.root")
    low = F.col("th") < F.col("h.th")
    ends = [F.when(low, x).otherwise(y) for x, y in ((F.col("th"), F.col("h.th")), (F.col("h.th"), F.col("th")), (F.col("root"), F.col("h.root")), (F.col("h.root"), F.col("root")))]
    return met.select(*[e.alias(c) for e, c in zip(ends, ("a", "b", "ra", "rb"))])


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): the roots of the ``pairs`` (a, b, ra, rb) of texts whose sets are that similar."""

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                ok.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in b.columns[:2]], ["a", "b"])

    x, y = (sets.select(F.col("th").alias(k), F.col("s").alias(f"s{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("ra", "rb", "sa", "sb").mapInArrow(compare, "a long, b long")


def relabelled(rows: DataFrame, tops: DataFrame | None) -> DataFrame:
    """``rows`` whose root is what it now leads to; tops: node, root."""
    if tops is None:
        return rows
    led = rows.join(tops.toDF("root", "top"), "root", "left")
    return led.select(*[F.coalesce("top", "root").alias("root") if c == "root" else F.col(c) for c in rows.columns])


def one_each(members: DataFrame, salt: int) -> DataFrame:
    """Of each bucket a text for each root, another one in each round: a group meets the hubs by it."""
    drawn = F.min_by(F.struct("th", "meets"), F.xxhash64("th", "key", F.lit(salt))).alias("t")
    return members.groupBy("key", "root").agg(drawn).select("key", "t.th", "root", "t.meets")


def cells(members: DataFrame) -> DataFrame:
    """(key, ci, cj, th, root, n): every two members of different roots of a bucket share a cell of two chunks.

    ``members``: key, size, weight, th, root, n.  A large bucket's most frequent root
    (cj < 0: its chunks) meets the others' chunks alone.
    """
    small = members.filter(~is_large()).select("key", F.lit(0).alias("ci"), F.lit(0).alias("cj"), "th", "root", "n")
    large = members.filter(is_large())
    per = large.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w")).groupBy("key")
    per = per.agg(F.max_by("root", F.struct("c", "root")).alias("major"), F.max_by(F.struct("c", "w"), F.struct("c", "root")).alias("m"), F.sum("c").alias("c"), F.sum("w").alias("w"), F.count("*").alias("roots"))
    chunks = lambda c, w: F.greatest(F.ceil(c / F.lit(CHUNK)), F.ceil(w / F.lit(WEIGHT)), F.lit(1)).cast("int")
    per = per.filter("roots > 1").select("key", "major", chunks(F.col("m.c"), F.col("m.w")).alias("km"), chunks(F.col("c") - F.col("m.c"), F.col("w") - F.col("m.w")).alias("ko"))
    dealt = join_split(large, per, ["key"])
    own = lambda k: F.pmod(F.xxhash64("th"), F.col(k)).cast("int")
    others = F.sequence(F.lit(0), F.col("ko") - 1)
    cell = lambda i, j: F.struct(i.cast("int").alias("ci"), j.cast("int").alias("cj"))
    of_major = F.transform(others, lambda i: cell(i, -1 - own("km")))
    of_other = F.concat(F.transform(others, lambda i: cell(F.least(i, own("ko")), F.greatest(i, own("ko")))), F.transform(F.sequence(F.lit(0), F.col("km") - 1), lambda j: cell(own("ko"), -1 - j)))
    placed = dealt.withColumn("cell", F.explode(F.when(F.col("root") == F.col("major"), of_major).otherwise(of_other)))
    return small.unionByName(placed.select("key", "cell.ci", "cell.cj", "th", "root", "n"))


def may_be_similar(placed: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """(gid, th, root): in each cell the components of what may be similar; equal ones of several cells are one."""
    keys = ["key", "ci", "cj"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        held = 0

        def record() -> pa.RecordBatch:
            rows = np.concatenate(out)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(3)], ["gid", "th", "root"])

        for g in groups(batches, keys):
            if g.num_rows < 2:
                continue
            th, root, n = (g.column(c).to_numpy() for c in ("th", "root", "n"))
            sketch = np.frombuffer(b"".join(g.column("sketch").to_pylist()), np.uint64).reshape(len(th), -1)
            for found in alike(th, root, n, sketch, percent):
                found = found[np.argsort(th[found])]
                gid = np.array([xxhash.xxh64_intdigest(th[found].tobytes())], np.uint64).view(np.int64)[0]
                out.append(np.stack([np.full(len(found), gid), th[found], root[found]], axis=1))
                held += len(found)
            if held > 50_000:
                yield record()
                out, held = [], 0
        if out:
            yield record()

    rows = placed.join(sketches, "th").select(*keys, "th", "root", "n", "sketch")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "gid long, th long, root long").dropDuplicates(["gid", "th"])


def linked(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): edges between the roots in ``found`` (gid, th, root) whose texts' sets are that similar."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, ["gid"]):
            own = [np.frombuffer(s, np.uint64) for s in g.column("s").to_pylist()]
            edges = similar_roots(own, g.column("root").to_numpy(), percent)
            if edges:
                a, b = zip(*edges)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    both = found.join(sets, "th").select("gid", "root", "s")
    return both.repartition("gid").sortWithinPartitions("gid").mapInArrow(run, "a long, b long")


def joined(own: DataFrame, texts: DataFrame, shingle: int, percent: int, name: str = "minhash", parts: int | None = None) -> DataFrame:
    """(th, root) for every text of ``own``, where groups with texts of that similarity are one; a written table.

    ``own``: one row a text: th, root (its group so far), n, bands, sketch; texts: th, text.
    """
    scratch: list[DataFrame] = []
    keep = lambda df, what: write_table(df, f"{name}-{what}", scratch, parts)
    keys = own.select("th", "root", "n", F.explode("bands").alias("key"))
    twice = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    some = keep(marked(keys, "key", twice).filter("__may").select("th", "root", "n", "key"), "some")
    members = keep(join_split(some, open_buckets(some), ["key"]), "members")
    links, tops = None, None
    large = members.filter(is_large())
    if not large.isEmpty():
        meets = large.groupBy("th").agg(F.sum("size").alias("meets"))
        near = keep(join_split(large, meets, ["th"]).select("key", "th", "root", "meets"), "large")
        sets = keep(shingle_sets(near.select("th"), texts, shingle), "large-sets")
        for salt in range(HUB_ROUNDS):
            pairs = hub_pairs(near, salt).dropDuplicates(["a", "b"])
            new = keep(similar(pairs, sets, percent), "hub-links")
            if new.isEmpty():
                break
            links = new if links is None else links.union(new)
            tops = connected(links, f"{name}-tops", parts=parts)
            scratch.append(tops)
            near = keep(one_each(relabelled(near, tops), salt), "groups")
    placed = cells(relabelled(members, tops))
    found = keep(may_be_similar(placed, own.select("th", "sketch"), percent), "alike")
    sets = keep(shingle_sets(found.select("th"), texts, shingle), "sets")
    new = keep(linked(found, sets, percent), "links")
    links = new if links is None else links.union(new)
    tops = connected(links, f"{name}-roots", parts=parts)
    scratch.append(tops)
    roots = write_table(relabelled(own.select("th", "root"), tops), f"{name}-joined", parts=parts)
    drop_table(*scratch)
    return roots


def drawn(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, th, n, bands, sketch) of every row: the text's hash, the size of its set, its keys and sketch."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [drawn_from(list(hashes(t, shingle))) for t in utf8(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *drawn_columns(own)], ["id", "th", "n", "bands", "sketch"])

    text = F.col(f"`{text_col}`").cast("string")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))
    return narrow.mapInArrow(run, f"id long, th long, {DRAWN}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, percent: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row of ``docs``.

    Texts are linked if 100 * shared shingles >= ``percent`` * shingles of either; component_id is
    the smallest id reachable, kept tells whether it is the row's own.
    """
    scratch: list[DataFrame] = []
    rows = write_table(drawn(docs, id_col, text_col, shingle), "op13-rows", scratch)
    parts = splits(rows)
    filled = rows.filter("n > 0")
    own = filled.groupBy("th").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    own = write_table(own.withColumn("root", F.col("th")), "op13-texts", scratch, parts)
    text = F.col(f"`{text_col}`").cast("string")
    texts = docs.select(F.xxhash64(text).alias("th"), text.alias("text"))
    roots = joined(own, texts, shingle, percent, "op13", parts)
    scratch.append(roots)
    led = own.select("th", "first").join(roots, "th")
    least = led.groupBy("root").agg(F.min("first").alias("component_id"))
    led = join_split(led.select("th", "root"), least, ["root"]).select("th", "component_id")
    found = join_split(filled.select("id", "th", "n"), led, ["th"]).select("id", "n", "component_id")
    found = found.union(rows.filter("n = 0").select("id", "n", F.col("id").alias("component_id")))
    out = found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    out = write_table(out, "op13-found", parts=parts)
    drop_table(*scratch)
    return out


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def sql() -> str:
    """The same rows by brute force: shared shingles of all pairs that share one, then all that is reachable."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least l ON l.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
