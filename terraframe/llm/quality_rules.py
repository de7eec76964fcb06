"""Quality rules: a learned decision list.

Statistics of every whole text are computed once (Arrow batches, numpy).  The
list is learned from labelled rows by sequential covering: grow a conjunction
of thresholds by information gain on two thirds of the rows, prune it on the
last third, keep it if it is precise there, remove what it covers, repeat.  The
result is a short ordered list that prints as text and runs as one Spark CASE
expression over the statistics.

Fitting takes at most ``max_labels`` labelled rows (default 20,000), those with
the smallest hashes of the id: a bounded sample, the same on every run.  All
else covers every row.

Defined cases: null text has no words and fails the base rules; a null or
repeated id is judged like any row; of the rows of a labelled id that repeats the
one with the least features (compared in their order) is learned from; labels that
are null are ignored, repeated labels count each time; without labels of both classes the list is empty and
keeps all that the base rules keep; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, utf8
from .storage import read, write_table

SYMBOLS = b"#*$%&|<>"
MAX_LABELS = 20_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "top_word", "n_marks", "n_short")
#: What conditions may test: ratios that do not drift with the length of a text, as the share of distinct words would.
FEATURES = {
    "word_length": "word_chars / n_words",
    "symbols_per_word": "n_symbols / n_words",
    "duplicate_lines": "n_dup_lines / n_lines",
    "repeated_words": "n_repeat_words / n_words",
    "upper_share": "n_upper / n_letters",
    "digit_share": "n_digits / word_chars",
    "top_word_share": "top_word / n_words",
    "marks_per_word": "n_marks / n_words",
    "short_share": "n_short / n_words",
}

_CLASS = np.zeros((256, 7), np.float32)  # space, symbol, upper, letter, digit, mark, continuation byte
for _c in range(256):
    _CLASS[_c] = [_c == 32 or 9 <= _c <= 13, _c in SYMBOLS, 65 <= _c <= 90, 65 <= _c <= 90 or 97 <= _c <= 122, 48 <= _c <= 57, chr(_c) in "!?;:", 128 <= _c < 192]
_CLASS = _CLASS.astype(np.float64)


def repeated_words(ids: np.ndarray) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(ids) - 2
    if n < 2:
        return 0
    d = int(ids.max()) + 1
    if d < 1 << 20:
        key = (ids[:-2] * d + ids[1:-1]) * d + ids[2:]
    else:
        pair = np.unique(ids[:-1] * d + ids[1:], return_inverse=True)[1]
        key = pair[:-1] * d + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(ids), bool)
    for k in range(3):
        hit[k : k + n] |= twice
    return int(hit.sum())


def counts(text: bytes) -> list[int]:
    words = text.split()  # white space is 0x20 and 0x09-0x0D
    n = len(words)
    if not n:
        return [0] * len(COUNTS)
    seen: dict[bytes, int] = {}
    number = seen.setdefault
    ids = np.array([number(w, len(seen)) for w in words], np.int64)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    space, symbols, upper, letters, digits, marks, cont = (hist @ _CLASS).astype(np.int64).tolist()
    lines = [x for x in text.split(b"\n") if x.strip()]
    freq = np.bincount(ids)
    short = sum(map((3).__gt__, map(len, words)))
    return [n, len(text) - cont - space, symbols, len(lines) - len(set(lines)), repeated_words(ids), len(lines), upper, letters, digits, int(freq.max()), marks, short]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, *COUNTS) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            m = np.array([counts(t) for t in utf8(b.column(1))], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(m[:, j]) for j in range(len(COUNTS))]], [id_col, *COUNTS])

    narrow = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("__text"))
    return narrow.mapInArrow(run, f"`{id_col}` long, " + ", ".join(f"{c} long" for c in COUNTS))


# -- the decision list --------------------------------------------------------


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def of(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        v = feature(self.feature)
        return v > F.lit(self.threshold) if self.above else v <= F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def feature(name: str) -> Column:
    top, _, bottom = FEATURES[name].partition(" / ")
    value = F.col(top).cast("double")
    return F.when(F.col(bottom) > 0, value / F.col(bottom)).otherwise(0.0) if bottom else value


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    hit = np.ones(n, bool)
    for c in rule:
        hit &= c.of(x)
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, cuts: dict[str, np.ndarray], longest: int) -> Rule:
    rule: list[Condition] = []
    rows = rows.copy()
    while len(rule) < longest and (~bad[rows]).any():
        p0, n0 = bad[rows].sum(), (~bad[rows]).sum()
        if not p0:
            break
        base, best = np.log2(p0 / (p0 + n0)), (1e-9, None)
        for f, ts in cuts.items():
            v, y = x[f][rows], bad[rows]
            order = np.argsort(v, kind="stable")
            at = np.searchsorted(v[order], ts, side="right")
            p_low = np.r_[0, np.cumsum(y[order])][at]
            for above, p, size in ((False, p_low, at), (True, p0 - p_low, len(rows) - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / size) - base), -1)
                j = int(np.argmax(gain))
                if gain[j] > best[0] and 0 < at[j] < len(rows):
                    middle = (v[order][at[j] - 1] + v[order][at[j]]) / 2  # between the observed values on either side
                    best = (gain[j], Condition(f, above, float(middle)))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = rows[best[1].of({best[1].feature: x[best[1].feature][rows]})]
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> tuple[Rule, float, int]:
    """The best prefix of the rule on held-out rows, its precision there and the rows it catches."""
    best: tuple[float, Rule, float, int] = (-2.0, (), 0.0, 0)
    sub = {f: v[rows] for f, v in x.items()}
    for k in range(len(rule), 0, -1):
        hit = covered(rule[:k], sub, len(rows))
        p, n = int(bad[rows][hit].sum()), int((~bad[rows][hit]).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best[0]:
            best = (worth, rule[:k], p / max(p + n, 1), p)
    return best[1:]


def learn(x: dict[str, np.ndarray], bad: np.ndarray, held_out: np.ndarray, precision: float = 0.95, longest: int = 3, most: int = 24) -> list[Rule]:
    """An ordered list of rules for bad rows; ``held_out`` marks the rows for pruning."""
    if not bad.any() or bad.all():
        return []
    cuts = {f: np.unique(np.quantile(v, np.linspace(0, 1, 65)[:-1])) for f, v in x.items()}
    cuts = {f: np.unique(np.r_[c, np.quantile(x[f][bad], np.linspace(0, 1, 33))]) for f, c in cuts.items()}
    grow, prune, rules = np.flatnonzero(~held_out), np.flatnonzero(held_out), []
    for _ in range(4 * most):
        if len(rules) == most or not bad[grow].any():
            break
        grown = _grow(x, bad, grow, cuts, longest)
        if not grown:
            break
        rule, sure, caught = _prune(grown, x, bad, prune)
        rule = rule or grown
        if sure >= precision and caught >= 2:
            rules.append(rule)
        # a rule that fails is dropped, with the rows it was grown for
        grow = grow[~covered(rule, {f: v[grow] for f, v in x.items()}, len(grow))]
        prune = prune[~covered(rule, {f: v[prune] for f, v in x.items()}, len(prune))]
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as one conditional expression: false for the first rule that fits, else true."""
    out = None
    for r in rules:
        cond = r[0].column()
        for c in r[1:]:
            cond &= c.column()
        out = F.when(cond, F.lit(False)) if out is None else out.when(cond, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", max_labels: int = MAX_LABELS, **options) -> list[Rule]:
    """Learn the list from at most ``max_labels`` labelled rows (quality 0 is bad) that pass the base rules."""
    sample = labels.select(F.col(id_col).cast("long").alias("__id"), F.col("quality").alias("__q")).dropna().orderBy(F.xxhash64("__id"), "__id", "__q").limit(max_labels)
    counted = sample.groupBy("__id", "__q").agg(F.count("*").alias("__n"))
    rows = stats.filter(~base_failed()).join(F.broadcast(counted), F.col(id_col) == F.col("__id"))  # max_labels rows at most
    # of the rows of a repeated id the one with the least features: a row for each labelled id, in whatever order they come
    own = F.min(F.struct(*[feature(f).alias(f) for f in FEATURES])).alias("f")
    got = rows.groupBy("__id", "__q", "__n").agg(own).select("__id", "__q", "__n", "f.*").toPandas()
    got = got.loc[got.index.repeat(got["__n"])].sort_values(["__id", "__q"], kind="stable")
    x = {f: got[f].to_numpy(float) for f in FEATURES}
    held_out = (got["__id"].to_numpy() * 2654435761 % 1_000_003) % 3 == 0
    return learn(x, got["__q"].to_numpy() == 0, held_out, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """``stats`` with base_failed and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & as_column(rules))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = write_table(statistics(read(spark, sf_dir, "documents")), "op10-statistics")
    rules = fit(stats, read(spark, sf_dir, "labels"))
    return judged(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
