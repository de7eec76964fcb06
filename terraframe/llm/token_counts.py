"""Edit-aware token counts.

``build`` gives each document a segment tree, one row a document: leaves are runs
of consecutive pre-tokens of the byte-level BPE with their length in characters,
their tokens and their number; inner nodes hold the sums, in heap order.  The
tree is a table that is kept: it names the version of the text that it counts by
the text's hash.

``recount`` takes such trees, the texts and a table of edits, and encodes only
the touched leaves again, with boundary context: splitting into pre-tokens starts
at the leaf that holds the second character before the edit (a pre-token depends
on at most two characters beyond its end) and goes on behind the edit until a new
boundary meets an old leaf's boundary.  From there on the split is the old one,
as the pattern never looks back.  All edits of a document are applied in one pass
from left to right; the sums above the touched leaves are then updated, level by
level.  It returns the new trees, under the hash of the new text, for the next
round of edits.  Documents without edits are not read: their tree has the counts.

Special tokens that stand in a text are counted as ordinary text: the pattern may cut them.

Defined cases: null text is empty (no tokens, a tree of one empty leaf); bytes that
are no UTF-8 count as U+FFFD; rows of
one id, null included, are told apart by their texts, and equal rows share a tree
with a count; edits outside a text are cut to it, overlapping ones are merged, the
first's replacement first, equal ones are one, ones of a version that isn't there
are ignored; an empty table gives an empty result; long texts are split and
encoded a piece at a time; a document's edits are held together by one task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, strings
from .storage import files, marked, read, write_table
from .tokenizers import ByteBpe, chunks

LEAF = 32
#: Copies of a row that one task makes.
COPIES = 1000
Edit = tuple[int, int, str]  # characters [start, end) become the text


class Tree:
    """Sums of characters, tokens and pre-tokens over leaves, in heap order (root 1): three rows of ``sums``."""

    def __init__(self, leaves: np.ndarray):
        self.n = leaves.shape[1]
        self.size = 1 << max(self.n - 1, 0).bit_length()
        self.sums = np.zeros((3, 2 * self.size), np.int64)
        self.sums[:, self.size : self.size + self.n] = leaves
        at = self.size
        while at > 1:
            at //= 2
            self.sums[:, at : 2 * at] = self.sums[:, 2 * at : 4 * at : 2] + self.sums[:, 2 * at + 1 : 4 * at : 2]

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[:, self.size : self.size + self.n]

    def find(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaves that hold characters (the last leaf beyond the end), and the leaves' first characters."""
        at, first = np.ones(len(chars), np.int64), np.zeros(len(chars), np.int64)
        while len(at) and at[0] < self.size:
            at = at * 2
            left = self.sums[0, at]
            right = chars >= first + left
            first += np.where(right, left, 0)
            at += right
        leaf = at - self.size
        beyond = leaf >= self.n
        return np.where(beyond, self.n - 1, leaf), np.where(beyond, self.sums[0, 1] - self.sums[0, self.size + self.n - 1], first)

    def set(self, leaves: np.ndarray, values: np.ndarray) -> None:
        """New values of some leaves; only the nodes above them are added up again."""
        at = np.unique(leaves + self.size)
        self.sums[:, leaves + self.size] = values
        while len(at) and at[0] > 1:
            at = np.unique(at // 2)
            self.sums[:, at] = self.sums[:, 2 * at] + self.sums[:, 2 * at + 1]

    @property
    def totals(self) -> tuple[int, int, int]:
        """Characters, tokens, pre-tokens."""
        return tuple(int(x) for x in self.sums[:, 1])

    def to_bytes(self) -> bytes:
        return self.leaves.astype("<i4").tobytes()

    @classmethod
    def of(cls, data: bytes) -> Tree:
        return cls(np.frombuffer(data, "<i4").reshape(3, -1).astype(np.int64))


class Counter:
    """Builds and updates trees."""

    def __init__(self, path: str | None = None, leaf: int = LEAF):
        import regex

        self.bpe, self.leaf = ByteBpe(path, special=False), leaf
        self.pattern = regex.compile(self.bpe.pattern)

    def count(self, text: str) -> int:
        return len(self.bpe.ids(text))

    def dealt(self, pieces: list[str], parts: int | None = None) -> list[tuple[int, int, int]]:
        """Characters, tokens and number of runs of pre-tokens: ``leaf`` each, or dealt into so many parts."""
        n = len(pieces)
        cuts = list(range(0, n, self.leaf)) + [n] if parts is None else [n * i // parts for i in range(parts + 1)]
        return [(sum(map(len, pieces[a:b])), self.run(pieces[a:b]), b - a) for a, b in zip(cuts, cuts[1:])]

    def run(self, pieces: list[str]) -> int:
        """Tokens of consecutive pre-tokens.  They split alike on their own, but for white space at the very end."""
        if len(pieces) > 1 and pieces[-1].isspace():
            return self.count("".join(pieces[:-1])) + self.count(pieces[-1])
        return self.count("".join(pieces))

    def build(self, text: str) -> Tree:
        leaves: list[tuple[int, int, int]] = []
        for part in chunks(text):  # a long text's pre-tokens are held a piece at a time
            leaves += self.dealt(self.pattern.findall(part))
        return Tree(np.array(leaves or [(0, 0, 0)], np.int64).T)

    def edit(self, text: str, tree: Tree, edits: list[Edit]) -> tuple[str, Tree, int]:
        """The edited text, its tree and the pre-tokens encoded again; edits refer to ``text``.

        Regions of leaves are encoded again one after the other; ``shift`` is what
        the edits so far have added to places in the text.
        """
        edits = merged(edits, len(text))
        if not edits:
            return text, tree, 0
        parts, last = [], 0
        for start, end, new in edits:
            parts += [text[last:start], new]
            last = end
        after = "".join([*parts, text[last:]])
        leaf_of, first_of = (x.tolist() for x in tree.find(np.array([max(s - 2, 0) for s, _, _ in edits], np.int64)))
        chars = tree.leaves[0].tolist()
        regions: list[tuple[int, int, list[tuple[int, int, int]]]] = []  # first and last leaf, and what they become
        again = shift = i = 0
        while i < len(edits):
            first, old_end = leaf_of[i], first_of[i]
            last, old_end = first, old_end + chars[first]
            pos = first_of[i] + shift
            pieces: list[str] = []
            matches = self.pattern.finditer(after, pos)
            while True:
                # edits that begin in the leaves taken so far, or so near behind that they reach back into them
                while i < len(edits) and (edits[i][0] - 2 < old_end or last + 1 == tree.n):
                    shift += len(edits[i][2]) - (edits[i][1] - edits[i][0])
                    while old_end < edits[i][1] and last + 1 < tree.n:
                        last += 1
                        old_end += chars[last]
                    i += 1
                while old_end + shift < pos and last + 1 < tree.n:
                    last += 1
                    old_end += chars[last]
                if i < len(edits) and (edits[i][0] - 2 < old_end or last + 1 == tree.n):
                    continue
                if pos == old_end + shift:
                    break
                found = next(matches, None)
                if found is None:
                    break
                pieces.append(found.group())
                pos = found.end()
            again += len(pieces)
            k = last - first + 1
            regions.append((first, last, self.dealt(pieces) if len(pieces) > 4 * self.leaf * k else self.dealt(pieces, k)))
        if all(b - a + 1 == len(new) for a, b, new in regions):
            tree.set(np.concatenate([np.arange(a, b + 1) for a, b, _ in regions]), np.array([v for _, _, new in regions for v in new], np.int64).T)
        else:
            old, out, last = tree.leaves, [], 0
            for a, b, new in regions:
                out += [old[:, last:a], np.array(new, np.int64).T]
                last = b + 1
            tree = Tree(np.concatenate([*out, old[:, last:]], axis=1))
        return after, tree, again


def merged(edits: list[Edit], n: int) -> list[Edit]:
    """Edits in order, inside the text, without overlaps."""
    out: list[list] = []
    for start, end, new in sorted((max(0, min(s, n)), max(0, min(max(s, e), n)), t) for s, e, t in edits):
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(new)
        else:
            out.append([start, end, [new]])
    return [(a, b, "".join(x)) for a, b, x in out]


#: Edits of a cleaning step: what is found, and what stands there afterwards.
REDACTIONS = [
    (re.compile(r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,4}"), "<email>"),
    (re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"), "<address>"),
    (re.compile(r"(?<!\w)\+?\d[\d ()-]{7,16}\d(?!\w)"), "<number>"),
]


def cleaning_edits(text: str) -> list[Edit]:
    """Redactions, and removal of lines that repeat an earlier one."""
    out: list[Edit] = []
    if "@" in text:
        out += [(m.start(), m.end(), REDACTIONS[0][1]) for m in REDACTIONS[0][0].finditer(text)]
    if any(c in text for c in "0123456789"):
        out += [(m.start(), m.end(), new) for p, new in REDACTIONS[1:] for m in p.finditer(text)]
    seen: set[str] = set()
    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if line.strip():
            if line in seen:
                out.append((max(at - 1, 0), end, ""))
            seen.add(line)
        at = end + 1
    return out


def _hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def versions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): the rows with the hash that names their text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(id, th, copies, n_chars, n_tokens, n_pretokens, tree): a tree for each version of each document, with its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, leaf)
        for b in slices(batches):
            trees = [counter.build(t) for t in strings(b.column(2))]
            m = np.array([t.totals for t in trees], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *[pa.array(m[:, j]) for j in range(3)], pa.array([t.to_bytes() for t in trees], pa.binary())], ["id", "th", "n_chars", "n_tokens", "n_pretokens", "tree"])

    rows = versions(docs, id_col, text_col).mapInArrow(run, "id long, th long, n_chars long, n_tokens long, n_pretokens long, tree binary")
    own = [F.first(c).alias(c) for c in ("n_chars", "n_tokens", "n_pretokens", "tree")]  # equal texts have equal trees
    return rows.groupBy("id", "th").agg(F.count("*").alias("copies"), *own)


def edits_of(docs: DataFrame, edits: Callable[[str], list[Edit]] = cleaning_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, start, end, new): the edits that a function derives from each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, out = [], []
            for i, t in enumerate(strings(b.column(2))):
                own = edits(t)
                rows += [i] * len(own)
                out += own
            if out:
                start, end, new = zip(*out)
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(new, pa.string())], ["id", "th", "start", "end", "new"])

    return versions(docs, id_col, text_col).mapInArrow(run, "id long, th long, start long, end long, new string")


COLUMNS = ("copies", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after", "n_chars_after")


def recount(trees: DataFrame, docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """(id, th, *COLUMNS, th_after, text_after, n_pretokens_after, tree_after) for each row of ``trees``.

    ``edits``: (id, th, start, end, new).  text_after is null where nothing was
    edited.  See :func:`trees_after` for the trees of the new versions.
    """
    by = edits.select("id", "th", "start", "end", "new").distinct().groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new"))).alias("edits"))
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["th"] == b["th"])
    asked = write_table(trees.alias("t").join(by.alias("e"), same(trees, by), "left").select("t.*", "e.edits"), "op5-asked", parts=files(trees))
    todo, rest = asked.filter("edits is not null"), asked.filter("edits is null")
    # only texts that may be edited are moved, equal rows once
    some = marked(versions(docs, id_col, text_col), "th", todo.select("th")).filter("__may").groupBy("id", "th").agg(F.first("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, leaf)
        for b in slices(batches, 200):
            rows, texts, out = [], [], []
            for data, own, text in zip(b.column("tree").to_pylist(), b.column("edits").to_pylist(), strings(b.column("text"))):
                tree = Tree.of(data)
                todo = merged([(x["start"], x["end"], x["new"] or "") for x in own], len(text))
                after, tree, again = counter.edit(text, tree, todo)
                chars, tokens, pre = tree.totals
                rows.append((len(todo), again, tokens, chars, pre))
                texts.append(after)
                out.append(tree.to_bytes())
            m = np.array(rows, np.int64).reshape(-1, 5)
            names = ["id", "th", "copies", "n_pretokens", "n_tokens", "n_edits", "n_reencoded", "n_tokens_after", "n_chars_after", "n_pretokens_after", "text_after", "tree_after"]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names[:5]] + [pa.array(m[:, j]) for j in range(5)] + [pa.array(texts, pa.string()), pa.array(out, pa.binary())], names)

    joined = some.alias("s").join(todo.alias("t"), F.col("s.id").eqNullSafe(F.col("t.id")) & (F.col("s.th") == F.col("t.th")))
    joined = joined.select("t.id", "t.th", "t.copies", "t.n_pretokens", "t.n_tokens", "t.tree", "t.edits", "s.text")
    kinds = "id long, th long, copies long, n_pretokens long, n_tokens long, n_edits long, n_reencoded long, n_tokens_after long, n_chars_after long, n_pretokens_after long, text_after string, tree_after binary"
    edited = joined.mapInArrow(run, kinds)
    zero = F.lit(0).cast("long")
    plain = rest.select("id", "th", "copies", "n_pretokens", "n_tokens", zero.alias("n_edits"), zero.alias("n_reencoded"), F.col("n_tokens").alias("n_tokens_after"), F.col("n_chars").alias("n_chars_after"), F.col("n_pretokens").alias("n_pretokens_after"), F.lit(None).cast("string").alias("text_after"), F.col("tree").alias("tree_after"))
    th = F.when(F.col("text_after").isNull(), F.col("th")).otherwise(F.xxhash64("text_after"))
    return edited.unionByName(plain).withColumn("th_after", th)


def trees_after(recounted: DataFrame) -> DataFrame:
    """The trees of the edited versions, as :func:`build` would give them but for the cuts between leaves."""
    rows = recounted.select("id", F.col("th_after").alias("th"), "copies", F.col("n_chars_after").alias("n_chars"), F.col("n_tokens_after").alias("n_tokens"), F.col("n_pretokens_after").alias("n_pretokens"), F.col("tree_after").alias("tree"))
    # versions that edits have made equal are one
    best = F.max_by(F.struct("n_chars", "n_tokens", "n_pretokens", "tree"), F.col("tree")).alias("b")
    return rows.groupBy("id", "th").agg(F.sum("copies").alias("copies"), best).select("id", "th", "copies", "b.*")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, before and after the cleaning edits, one row each."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    few = files(docs)
    trees = write_table(build(docs), "op5-trees", parts=few)
    found = recount(trees, docs, edits_of(docs))
    # many tasks make the copies of a hot row, a chunk each
    size = F.lit(COPIES).cast("long")
    chunks = found.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("copies") - 1, size)))).hint("rebalance")
    each = chunks.select("id", *COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("copies") - F.col("chunk") * size, size))).alias("copy"))
    return each.select(F.col("id").alias("doc_id"), *COLUMNS[1:]).coalesce(few)
