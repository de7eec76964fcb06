"""Benchmark decontamination by latent semantic retrieval.

1. The words of every document are hashed once, into a written table (two bytes a
   word) beside the texts.  Document frequencies come from it (partial counts per
   partition, summed by Spark; a constant number of cells).
2. A randomised SVD of TF-IDF passages, distributed: partitions accumulate
   A'(A W) for a random W; the sums are added up in a tree of bounded fan-in and orthogonalised on the
   driver (a constant size: cells by rank).  It takes every document, copies
   included as in the document frequencies, together with all benchmark passages,
   which weigh more, so that the latent space spans them.  There is one basis,
   whatever the number of items.
3. Candidate search: every document's windows, of lengths that match the
   benchmark passages, are folded into the latent space and looked up by cosine
   in an index of the passages of that length (:class:`Index`: clusters around 3
   sqrt(n) centroids; a window is compared with the passages of the
   clusters that may hold a match).  Among thousands of short passages 48 dimensions
   tell too little of a paraphrase, so these have a second index, of pairs of
   neighbouring words (:class:`Pairs`): a passage of n words of which 60 % are left in
   place keeps one at least.  Every row is searched; there is no cap on candidates.
4. Checks: the longest common subsequence of words between a candidate window
   and the passage must cover ``copy`` of the passage, or ``paraphrase`` of it
   together with the answer (the passage's last sentence).

The benchmark is the stated query set; it is searched in blocks of about
``item_block`` items, one pass over the documents a block, so what the driver
holds and ships to executors is bounded; the blocks share the basis.

Defined cases: null or wordless text matches nothing; a passage without words
is ignored, one under ``least`` words must occur as a whole; null or repeated
ids are carried as they are; empty tables give an empty result.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, strings, tidy
from .storage import drop_table, files, read, small_batches, without_rows, write_table

CELLS = 1 << 16
RANK = 48
STEP = 4  # words in a block; windows begin at block boundaries
#: Window length and stride in blocks, for passages up to so many words.
WINDOWS = ((12, 3, 1), (24, 5, 1), (38, 8, 2), (64, 12, 3))
_BLANK = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


PIECE = 30_000  # words searched at once; pieces of a longer text overlap by OVERLAP
OVERLAP = 256
SLICE = 1 << 20  # bytes hashed at once
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)


def normal(text: str | None) -> bytes:
    """Lower-cased, everything but letters and digits blank."""
    return text.lower().encode().translate(_BLANK) if text else b""


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of letters and digits."""
    return normal(text).split()


def _hashed(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = np.empty(len(a) + 2, np.int8)
    letter[0] = letter[-1] = 0
    np.not_equal(a, 32, out=letter[1:-1].view(bool))
    edge = np.diff(letter)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, ends, starts
    lens = ends - starts
    first = np.cumsum(lens) - lens
    k = np.arange(int(lens.sum())) - np.repeat(first, lens)
    h = np.add.reduceat((a[letter[1:-1].view(bool)].astype(np.uint64) + np.uint64(1)) * _POWERS[k & 4095], first)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return starts, ends, (h >> np.uint64(48)).astype(np.int64)


def scan(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and cells of the words of a normal text, a slice at a time."""
    a, out, at = np.frombuffer(text, np.uint8), [], 0
    while at < len(text):
        to = len(text)
        if to - at > SLICE:  # never inside a word
            to = text.find(b" ", at + SLICE)
            to = len(text) if to < 0 else to
        s, e, c = _hashed(a[at:to])
        out.append((s + at, e + at, c))
        at = to
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


def cells_of(words: list[bytes]) -> np.ndarray:
    """The cells of single words."""
    return scan(b" ".join(words))[2]


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (__id, __text) with the text's hash and its words' cells, as 16-bit numbers."""

    @F.arrow_udf("binary")
    def cells(texts: pa.Array) -> pa.Array:
        return pa.array([scan(normal(t))[2].astype("<u2").tobytes() for t in strings(texts)], pa.binary())

    return docs.select("__id", "__text", F.xxhash64("__text").alias("__th"), cells("__text").alias("__cells"))


def read_cells(value: bytes | None) -> np.ndarray:
    return np.frombuffer(value or b"", "<u2").astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Documents, and documents per cell, over all of ``docs`` (column __cells)."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(CELLS, np.int64)
        for b in slices(batches, 1000):
            words = b.column(0).to_pylist()
            n, at = n + len(words), 0
            while at < len(words):  # some ten thousand words at a time
                cells, sizes = [], []
                while at < len(words) and sum(sizes) < PIECE:
                    cells.append(np.frombuffer(words[at] or b"", "<u2"))
                    sizes.append(len(cells[-1]))
                    at += 1
                doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
                keys = doc * np.uint64(CELLS) + np.concatenate(cells).astype(np.uint64)
                keys = np.sort(keys.astype(np.uint32) if len(sizes) < CELLS else keys)
                if len(keys):
                    total += np.bincount((keys[np.r_[True, keys[1:] != keys[:-1]]] % CELLS).astype(np.int64), minlength=CELLS)
        at = np.flatnonzero(total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, total[at]])], ["cell", "n"])

    out, n = np.zeros(CELLS, np.int64), 0
    with small_batches(docs.sparkSession):
        got = docs.select("__cells").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # CELLS rows and one
    cell, k = got.column("cell").to_numpy(), got.column("n").to_numpy()
    out[cell[cell >= 0]] = k[cell >= 0]
    n = int(k[cell < 0].sum())
    return n, out


@dataclass
class Item:
    item: int
    words: list[bytes]
    answer: list[bytes]

    def __post_init__(self) -> None:
        self.different = frozenset(self.words)


def passages(items: list[tuple[int, str | None]], longest: int = 60) -> list[Item]:
    """Benchmark items as passages of up to ``longest`` words; the answer is the item's last sentence."""
    out = []
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        sentences = [s for s in (words_of(x) for x in re.split(r"[.!?\n]+", text)) if s]
        parts = -(-len(words) // longest)
        for i in range(parts):
            part = words[len(words) * i // parts : len(words) * (i + 1) // parts]
            out.append(Item(item, part, sentences[-1] if i == parts - 1 and len(sentences) > 1 else part[-8:]))
    return out


PASSAGE = 32  # words of a passage of the fit
FOLDED = 1000 * PASSAGE  # words added up at once
OFTEN = 16  # a cell that occurs more often among them is counted by passage


def accumulate(total: np.ndarray, parts: list[np.ndarray], scaled: np.ndarray, idf: np.ndarray) -> None:
    """Add y to the row of ``total`` of every word of a passage, y: the passage's sum of ``scaled``, over its sum of squared ``idf``.

    parts: the cells of the words of texts, each cut into passages; ``scaled`` and ``idf`` have a last row of zeros.
    """
    counts = [-(-len(x) // PASSAGE) for x in parts]
    ends = np.cumsum(counts)
    n = int(ends[-1]) if len(ends) else 0
    if not n:
        return
    padded = np.full(n * PASSAGE, CELLS, np.int64)  # the last row
    for x, e, k in zip(parts, ends, counts):
        at = (int(e) - k) * PASSAGE
        padded[at : at + len(x)] = x
    y = np.zeros((n, scaled.shape[1]), np.float32)
    row, square = np.empty_like(y), np.zeros(n, np.float32)
    for place in np.ascontiguousarray(padded.reshape(n, PASSAGE).T):  # the passages' first words, their second ones, ...
        y += np.take(scaled, place, axis=0, out=row, mode="clip")
        square += idf[place] ** 2
    y /= np.maximum(square, 1e-9)[:, None]
    # the words by cell, the commonest cells first
    at = np.flatnonzero(padded < CELLS)
    ids = padded[at].astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    ids, passage = ids[order], at[order] // PASSAGE
    first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    times = np.diff(np.r_[first, len(ids)])
    order = np.argsort(-times, kind="stable")
    first, times = first[order], times[order]
    sums = np.zeros((len(first), y.shape[1]), np.float32)
    often = int(np.count_nonzero(times > OFTEN))
    if often:
        t = times[:often]
        place = passage[np.arange(int(t.sum())) + np.repeat(first[:often] - (np.cumsum(t) - t), t)]
        sums[:often] = np.bincount(np.repeat(np.arange(often), t) * n + place, minlength=often * n).reshape(often, n).astype(np.float32) @ y
    for k in range(OFTEN):  # the others' first occurrences, their second ones, ...
        upto = int(np.count_nonzero(times > k))
        if upto > often:
            sums[often:upto] += y[passage[first[often:upto] + k]]
    total[ids[first]] += sums


class Drawn:
    """W times idf: a random matrix, cells by ``width``, which travels as its seed and is drawn where it is used."""

    def __init__(self, idf: np.ndarray, width: int, seed: int):
        self.idf, self.width, self.seed = idf, width, seed

    def matrix(self) -> np.ndarray:
        """It, with a last row of zeros."""
        out = np.zeros((CELLS + 1, self.width), np.float32)
        np.random.default_rng(self.seed).standard_normal(dtype=np.float32, out=out[:CELLS])
        out[:CELLS] *= self.idf[:, None]
        return out

    @functools.cached_property
    def _kept(self) -> np.ndarray:
        return self.matrix()

    def __getitem__(self, cells: np.ndarray) -> np.ndarray:
        return self._kept[cells]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_kept"}


#: Sums that are added up in one call, and the least files' worth of rows a task of the fit takes.
FAN_IN, FIT_FILES = 16, 64


def summed_rows(rows: DataFrame, parts_of, drawn: Drawn, idf: np.ndarray) -> np.ndarray:
    """A'(A W) over all rows, in slices of 1024 cells; ``parts_of`` gives the cells of a row's words, by what is cut into passages.

    drawn: W times idf.  A task's sums are of a constant size; tasks grow with the rows, half a GB each, and
    their sums are added up FAN_IN at a time.
    """
    width = drawn.width

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scaled, weights = drawn.matrix(), np.r_[idf, np.float32(0)]
        total = np.zeros((CELLS, width), np.float32)
        parts, n = [], 0
        for b in slices(batches, 1000):
            for t in b.column(0).to_pylist():
                for x in parts_of(t):
                    for at in range(0, len(x), FOLDED):
                        parts.append(x[at : at + FOLDED])
                        n += len(parts[-1])
                        if n >= FOLDED:
                            accumulate(total, parts, scaled, weights)
                            parts, n = [], 0
        accumulate(total, parts, scaled, weights)
        task = TaskContext.get().partitionId()
        for k in range(0, CELLS, 1024):
            if total[k : k + 1024].any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([task], pa.int64()), pa.array([total[k : k + 1024].tobytes()], pa.binary())], ["cell", "task", "v"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float32) for v in parts.column("v").to_pylist())
        return pa.table({"cell": parts.column("cell")[:1], "task": parts.column("task")[:1], "v": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    out = np.zeros((CELLS, width), np.float32)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, files(rows) // FIT_FILES)
    with small_batches(rows.sparkSession):
        sums = rows.coalesce(tasks).mapInArrow(run, "cell long, task long, v binary")
        while tasks > 1:
            tasks = -(-tasks // FAN_IN)
            sums = sums.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("cell", "task").applyInArrow(add, "cell long, task long, v binary")
        for cell, _, v in sums.toLocalIterator():  # the sums: a constant size
            out[cell : cell + 1024] = np.frombuffer(v, np.float32).reshape(-1, width)
    out *= idf[:, None]
    return out


def latent(docs: DataFrame, bench: DataFrame, idf: np.ndarray, share: float = 1.0, rank: int = RANK, oversample: int = 16, seed: int = 5) -> np.ndarray:
    """Cells by rank: the leading right singular vectors of the TF-IDF passages, times idf.

    One basis for the whole benchmark, whatever its size: its passages are summed
    up on the cluster like those of the documents.  docs: __text, __cells; bench: item, text;
    share: of the texts, by hash, where a caller wants fewer than all.
    """
    width = rank + oversample
    drawn = Drawn(idf, width, seed)
    if share < 1:
        docs = docs.filter(F.pmod(F.xxhash64("__text"), F.lit(1_000_003)) < int(share * 1_000_003))
    total = summed_rows(docs.select("__cells"), lambda c: [read_cells(c)], drawn, idf)
    own = summed_rows(bench.select("text"), lambda t: [cells_of(it.words) for it in passages([(0, t)])], drawn, idf)
    size = float(np.linalg.norm(total)) or 1.0
    own *= np.float32(2.0 * size / (float(np.linalg.norm(own)) or 1.0))
    total += own
    del own
    # an orthonormal basis by way of the small matrix of products: no second copy of the large one
    parts = (total[k : k + 4096].astype(np.float64) for k in range(0, CELLS, 4096))
    values, vectors = np.linalg.eigh(sum(x.T @ x for x in parts))
    q = total @ (vectors * np.where(values > 1e-10 * max(values[-1], 1e-30), 1 / np.sqrt(np.maximum(values, 1e-30)), 0.0)).astype(np.float32)
    del total
    q *= idf[:, None]

    # rotate into singular directions of the benchmark passages and keep the leading ones
    @tidy
    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((width, width))
        for b in batches:
            for t in b.column(0).to_pylist():
                for it in passages([(0, t)]):
                    a = q[cells_of(it.words)].sum(axis=0, dtype=np.float64)
                    g += np.outer(a, a)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(g.ravel())], ["i", "v"])

    with small_batches(bench.sparkSession):
        parts = bench.select("text").coalesce(8).mapInArrow(gram, "i long, v double").groupBy("i").agg(F.sum("v")).collect()  # width squared rows
    g = np.zeros(width * width)
    for i, v in parts:
        g[i] = v
    _, vectors = np.linalg.eigh(g.reshape(width, width))
    return q @ vectors[:, ::-1][:, :rank].astype(np.float32)


class Index:
    """Approximate search among passages: unit vectors in clusters around centroids.

    A window looks only into clusters whose centroid is near enough.  Of a vector at
    cosine c to a member whose cosine to the centroid is r, the cosine to the centroid
    is about c r, with a spread of sqrt((1 - c^2) (1 - r^2) / rank); a cluster is left
    out if that would have to be ``sure`` spreads less, for each of its members.
    """

    def __init__(self, vectors: np.ndarray, cosine: float, sure: float = 1.5, rounds: int = 6):
        n, rank = vectors.shape
        k = min(n, int(np.ceil(3 * np.sqrt(n))))
        centers = vectors[np.linspace(0, n - 1, k).astype(int)].copy()
        for _ in range(rounds):
            own = np.argmax(vectors @ centers.T, axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, vectors)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centers)
        own = np.argmax(vectors @ centers.T, axis=1)
        self.members = [np.flatnonzero(own == j) for j in range(k)]
        kept = [j for j in range(k) if len(self.members[j])]
        self.members = [self.members[j] for j in kept]
        self.centers = np.ascontiguousarray(centers[kept].T)
        self.parts = [np.ascontiguousarray(vectors[m].T) for m in self.members]
        self.cosine = cosine
        self.cuts = []
        for c, m in zip(self.centers.T, self.members):
            r = np.clip(vectors[m] @ c, 0, 1)
            self.cuts.append(float((cosine * r - sure * np.sqrt((1 - cosine**2) * (1 - r * r) / rank)).min()))

    def search(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Rows, passages and cosines of the pairs above the cosine that are found, and how many pairs were compared."""
        norm = np.maximum(np.sqrt(np.einsum("ij,ij->i", v, v)), 1e-6)
        near = v @ self.centers
        rows, cols, sims, compared = [], [], [], 0
        for k, (m, part, cut) in enumerate(zip(self.members, self.parts, self.cuts)):
            some = np.flatnonzero(near[:, k] > cut * norm)
            if not len(some):
                continue
            sim = v[some] @ part
            compared += sim.size
            r, c = np.nonzero(sim > (self.cosine * norm[some])[:, None])
            if len(r):
                rows.append(some[r])
                cols.append(m[c])
                sims.append(sim[r, c] / norm[some[r]])
        if not rows:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.float32), compared
        return np.concatenate(rows), np.concatenate(cols), np.concatenate(sims), compared


#: Passages of up to so many words are also looked up by their pairs of words.
SHORT = 24
_MARKS = 1 << 22


class Pairs:
    """Short passages by their pairs of neighbouring words, single words by themselves.

    A window's words are compared with a passage's wherever one of its pairs occurs; at least ``share`` of
    them must be there, in any order.
    """

    def __init__(self, items: list[Item], share: float, least: int):
        self.items = [i for i, it in enumerate(items) if len(it.words) <= SHORT]
        self.words = np.full((len(self.items), SHORT), -1, np.int64)
        keys, owner, offset = [], [], []
        for k, i in enumerate(self.items):
            c = cells_of(items[i].words)
            self.words[k, : len(c)] = c
            pairs = c[:-1] * CELLS + c[1:] if len(c) > 1 else c + CELLS * CELLS
            keys.append(pairs)
            owner.append(np.full(len(pairs), k))
            offset.append(np.arange(len(pairs)))
        self.size = (self.words >= 0).sum(axis=1)
        self.need = np.where(self.size < least, self.size, np.ceil(share * self.size - 1e-9))
        keys, owner, offset = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, owner, offset))
        order = np.argsort(keys, kind="stable")
        self.keys, self.owner, self.offset = keys[order], owner[order], offset[order]
        self.marks = np.zeros(_MARKS, bool)
        self.marks[self.place(self.keys)] = True
        self.single = bool((self.size == 1).any())

    @staticmethod
    def place(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def search(self, words: np.ndarray, first: np.ndarray, last: np.ndarray, margin: int = 8) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): where in ``words`` a passage may begin; first, last: of each word the bounds of its text."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(words) and len(self.keys):
            pairs = words[:-1] * CELLS + words[1:]
            at = np.flatnonzero(self.marks[self.place(pairs)])
            found.append((at[first[at] == first[at + 1]], pairs))
            if self.single:
                alone = words + CELLS * CELLS
                found.append((np.flatnonzero(self.marks[self.place(alone)]), alone))
        places, items = [], []
        for at, keys in found:
            low, high = (np.searchsorted(self.keys, keys[at], side=s) for s in ("left", "right"))
            n = high - low
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin, k = np.repeat(at, n) - self.offset[entry], self.owner[entry]
            if not len(k):
                continue
            origin = np.repeat(first[at], n)
            # pairs of one passage at one place are one
            _, once = np.unique((begin + SHORT) * len(self.items) + k, return_index=True)
            begin, k, origin, end = begin[once], k[once], origin[once], np.repeat(last[at], n)[once]
            for part in range(0, len(k), 10_000):
                p = slice(part, part + 10_000)
                window = begin[p, None] - margin + np.arange(SHORT + 2 * margin)
                inside = (window >= origin[p, None]) & (window < end[p, None]) & (window < begin[p, None] + self.size[k[p], None] + margin)
                seen = np.where(inside, words[np.clip(window, 0, len(words) - 1)], -2)
                there = (self.words[k[p], :, None] == seen[:, None, :]).any(axis=2).sum(axis=1)
                ok = there >= self.need[k[p]]
                places.append(np.maximum(begin[p][ok], origin[p][ok]))
                items.append(np.array(self.items)[k[p][ok]])
        none = np.zeros(0, np.int64)
        return (np.concatenate(places), np.concatenate(items)) if places else (none, none)


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def verdict(item: Item, window: list[bytes], copy: float, paraphrase: float, least: int) -> float:
    """Share of the passage found in the window if it counts as leaked, else 0."""
    n = len(item.words)
    if n < least:
        return float(b" %s " % b" ".join(item.words) in b" %s " % b" ".join(window))
    if len(item.different.difference(window)) > (1 - paraphrase) * n:  # too many words are not there at all
        return 0.0
    share = common_subsequence(item.words, window) / n
    if share >= copy:
        return share
    if share >= paraphrase and common_subsequence(item.answer, window) >= 0.8 * len(item.answer):
        return share
    return 0.0


MATCH = "id long, th long, item_id long, share double, cosine double"


def leaks(docs: DataFrame, items: list[Item], basis: np.ndarray, cosine: float, copy: float, paraphrase: float, least: int) -> DataFrame:
    """(id, th, item_id, share, cosine): the best match of each row and item of this block."""
    classes = []
    for k, (upto, blocks, stride) in enumerate(WINDOWS):
        low = WINDOWS[k - 1][0] if k else 0
        own = [i for i, it in enumerate(items) if low < len(it.words) <= upto]
        if own:
            m = np.stack([basis[cells_of(items[i].words)].sum(axis=0) for i in own])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
            classes.append((np.array(own), blocks, stride, Index(m, cosine)))

    short = Pairs(items, paraphrase, least)

    def search(pieces: list[tuple[int, str, int]], ids: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float]]:
        """The best matches of pieces (row, text, words before it), known by the cells of their words."""
        found: dict[tuple[int, int], tuple[float, float]] = {}
        blocks_of = [-(-len(x) // STEP) for x in ids]
        ends = np.cumsum(blocks_of)
        total = int(ends[-1]) if len(ends) else 0
        if not total:
            return found
        padded = np.full(total * STEP, CELLS, np.int64)  # the row after the last is zero
        for x, e, n in zip(ids, ends, blocks_of):
            at = (int(e) - n) * STEP
            padded[at : at + len(x)] = x
        sums = np.zeros((total + 1, basis0.shape[1]), np.float32)
        np.cumsum(basis0[padded].reshape(total, STEP, -1).sum(axis=1), axis=0, out=sums[1:])
        doc = np.repeat(np.arange(len(ids)), blocks_of)
        split: dict[int, list[bytes]] = {}  # words of the pieces that have candidates
        tried: set[tuple[int, int, int]] = set()

        def check(d: int, start: int, blocks: int, i: int, near: float) -> None:
            row, text, before = pieces[d]
            if d not in split:
                split[d] = normal(text).split()[before : before + len(ids[d])]
            margin = STEP * max(2, blocks // 2)
            share = verdict(items[i], split[d][max(0, start - margin) : start + blocks * STEP + margin], copy, paraphrase, least)
            if share:
                key, now = (row, items[i].item), (share, near)
                found[key] = max(found.get(key, (0.0, 0.0)), now)

        for own, blocks, stride, index in classes:
            s = np.arange(0, total, stride)
            e = np.minimum(s + blocks, ends[doc[s]])
            for r, c, near in zip(*index.search(sums[e] - sums[s])[:3]):
                d = int(doc[s[r]])
                start = (int(s[r]) - (int(ends[d]) - blocks_of[d])) * STEP
                check(d, start, blocks, int(own[c]), float(near))
        if short.items:
            lens = np.array([len(x) for x in ids])
            last = np.cumsum(lens)
            piece = np.repeat(np.arange(len(ids)), lens)
            words = np.concatenate(ids)
            for at, i in zip(*(x.tolist() for x in short.search(words, (last - lens)[piece], last[piece]))):
                d = int(piece[at])
                blocks, start = next(b for upto, b, _ in WINDOWS if len(items[i].words) <= upto), at - int(last[d] - lens[d])
                if (d, start, i) not in tried:
                    tried.add((d, start, i))
                    window = basis[words[at : min(at + len(items[i].words), int(last[d]))]].sum(axis=0)
                    own_vector = basis[cells_of(items[i].words)].sum(axis=0)
                    near = float(window @ own_vector / max(float(np.linalg.norm(window) * np.linalg.norm(own_vector)), 1e-9))
                    check(d, start, blocks, i, near)
        return found

    basis0 = np.vstack([basis, np.zeros((1, basis.shape[1]), np.float32)])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1000):
            out: dict[tuple[int, int], tuple[float, float]] = {}
            pieces, ids, n = [], [], 0

            def flush() -> None:
                for key, now in search(pieces, ids).items():
                    out[key] = max(out.get(key, (0.0, 0.0)), now)

            for row, (t, c) in enumerate(zip(strings(b.column(1)), b.column(3).to_pylist())):
                cell = read_cells(c)
                for at in range(0, max(len(cell) - OVERLAP, 1), PIECE - OVERLAP):
                    pieces.append((row, t, at))
                    ids.append(cell[at : at + PIECE])
                    n += len(ids[-1])
                    if n >= PIECE:
                        flush()
                        pieces, ids, n = [], [], 0
            flush()
            if out:
                rows, item, share, sim = zip(*[(r, i, x, y) for (r, i), (x, y) in out.items()])
                rows = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(item, pa.int64()), pa.array(share, pa.float64()), pa.array(sim, pa.float64())], ["id", "th", "item_id", "share", "cosine"])

    return docs.select("__id", "__text", "__th", "__cells").mapInArrow(run, MATCH)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", cosine: float = 0.75, copy: float = 0.75, paraphrase: float = 0.6, least: int = 8, item_block: int = 20_000, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(id, th, item_id, share, cosine) for each row and benchmark item that it leaks; th: the hash of the row's text.

    ``scratch`` takes note of the tables that the result reads.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    spark = docs.sparkSession
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item"), F.col(f"`{item_text}`").cast("string").alias("text"))
    bench = bench.filter("text is not null").distinct()  # an item that repeats is one
    blocks = -(-bench.count() // item_block)
    out = basis = None
    for k in range(blocks):  # of the query set, dealt by hash: a bounded part at a time on the driver and in what is shipped
        part = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        ask = [(r.item, r.text) for r in part.collect()]
        items = passages(sorted(ask, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "")))
        if not items:
            continue
        if basis is None:
            rows = write_table(scanned(rows), "op8-scanned", scratch, files(rows))
            n, df = document_frequencies(rows)
            idf = np.log((n + 1.0) / (df + 1.0)).astype(np.float32) + 0.05
            basis = latent(rows, bench, idf)
        found = leaks(rows, items, basis, cosine, copy, paraphrase, least)
        found = write_table(found, "op8-block", scratch) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], MATCH)
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", *args, **options) -> DataFrame:
    """(id_col, item_id, share, cosine) for each document and benchmark item that it leaks; see :func:`matches`."""
    out = matches(docs, benchmark, id_col, *args, **options)
    best = F.max(F.struct("share", "cosine")).alias("b")
    return out.groupBy("id", "item_id").agg(best).select(F.col("id").alias(id_col), "item_id", "b.share", "b.cosine")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that leak a benchmark item: a row is known by its id and the hash of its text."""
    scratch: list[DataFrame] = []
    found = matches(docs, benchmark, id_col, text_col, scratch=scratch).select(F.col("id").alias("__lid"), F.col("th").alias("__lth")).distinct()
    leaks_ = write_table(found, "op8-leaks", parts=files(docs))
    drop_table(*scratch)
    return without_rows(docs, leaks_, id_col, F.col(f"`{text_col}`"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
