"""Language ID by Bayesian evidence fusion.

For each document and language the log evidence is added up:

* text: smoothed likelihoods of hashed byte trigrams of the letters, one model
  per declared language, however rare, trained on all its different texts (each
  counts once, whatever its copies); a rival class without a language gives every
  trigram the same probability.  The sum is tempered, as
  neighbouring trigrams are not independent;
* declared markup language: P(declared | language), from counts of declared
  against text language over all rows;
* address suffix: P(suffix | language), likewise;
* host: a prior smoothed level by level, host to domain to suffix to all, each
  level a grouped count over all rows.

The text is read by Arrow batches once to train and once to weigh it; everything
after that works on a narrow written table with DataFrame functions.  A document is rejected if it
has no letters, no language explains it better than the rival class, or the
best posterior is under ``least``.

Defined cases: null text has no letters and is rejected; null or empty declared
language, host or suffix gives no evidence; null and repeated ids are carried
as they are; an empty table gives an empty result; a table whose declared rows
have under ``support`` trigrams in all leaves nothing to learn and every row is
rejected.  A language known from a row or two is modelled on these rows alone, so
its own documents pass.

Languages are taken ``BLOCK`` at a time: a worker holds the models of a block (8 MB),
a row the numbers of a block; what the blocks say of a row is put together by maxima and sums of
exponentials, which lose nothing.  A declared language's name is all that the driver
holds of each.  Every block reads the texts once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, tidy, utf8
from .storage import drop_table, join_split, marked, read, small_batches, without_rows, write_table
from .url_filter import host_of

CELLS = 1 << 15
#: Languages whose models are held at a time.
BLOCK = 64
UNKNOWN = "und"
_LETTERS = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Cells of the trigrams over letters and single spaces."""
    b = np.frombuffer(b" " + b" ".join(text.lower().translate(_LETTERS).split()) + b" ", np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(0, np.int64)
    code = b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]
    return (code * np.uint32(2654435769) >> np.uint32(17)).astype(np.int64)


#: How much worse than an even guess among the seen trigrams the rival class is, a trigram: short
#: texts of odd words stay with their declared language, other scripts and noise do not.
RIVAL_MARGIN = 1.0
#: Pseudo-counts of a language model: a half a cell, and this share of its trigrams at most.
UNSEEN = 0.25
NEVER = -60.0  # log probability under a language without a trigram


COUNTED = 1 << 20  # trigrams held before they are counted


@dataclass
class Models:
    """Language models as counts: a written table (cell + CELLS * language, n), and what smoothing needs of all of it."""

    names: list[str]
    counts: DataFrame | None
    seen: int

    @property
    def blocks(self) -> list[tuple[int, int]]:
        """Ranges of classes: languages in order, the rival class after the last."""
        return [(i, min(i + BLOCK, len(self.names))) for i in range(0, max(len(self.names), 1), BLOCK)]

    def classes(self, begin: int, end: int) -> list[str]:
        return [*self.names[begin:end], *[UNKNOWN] * (end == len(self.names))]

    def table(self, begin: int, end: int) -> np.ndarray:
        """Log probabilities, cells by the classes of a block."""
        if self.counts is None:
            return np.zeros((CELLS, 1), np.float32)
        p = np.zeros((end - begin) * CELLS, np.float32)
        got = self.counts.filter((F.col("cell") >= begin * CELLS) & (F.col("cell") < end * CELLS)).toArrow()  # BLOCK x CELLS rows at most
        p[got.column("cell").to_numpy() - begin * CELLS] = got.column("n").to_numpy()
        p = p.reshape(-1, CELLS)
        for i, total in enumerate(p.sum(axis=1, dtype=np.float64)):
            if total:
                # a small language gives what it has not seen UNSEEN of its mass at most, else it would suit any noise better than the rival class
                add = min(0.5, UNSEEN * total / self.seen)
                p[i] = np.log((p[i] + add) / (total + add * self.seen))
            else:  # declared only by rows without letters
                p[i] = NEVER
        if end == len(self.names):
            p = np.vstack([p, np.full((1, CELLS), -RIVAL_MARGIN - np.log(self.seen), np.float32)])
        return np.ascontiguousarray(p.T)


def train(rows: DataFrame, per_language: int | None = None, support: int = 20, scratch: list[DataFrame] | None = None) -> Models:
    """A model of every declared language of ``rows`` (declared, text).

    Every declared language with letters gets a model of all its different texts; under ``support`` trigrams over
    all of them there is nothing to learn from.  per_language: of about so many rows each, by hash of the text, where
    a caller wants fewer than all.
    """
    counted = rows.filter("declared <> ''").groupBy("declared").count().orderBy(F.desc("count"), "declared")
    counted = counted.collect()  # a row for each language
    names = sorted(r[0] for r in counted)
    if not names:
        return Models([], None, 2)
    place = {n: i for i, n in enumerate(names)}
    known = rows.filter("declared <> ''").select("declared", "text", F.xxhash64("text").alias("h"))
    limit = {r[0]: int(per_language / r[1] * 1_000_003) for r in counted if r[1] > per_language} if per_language else {}
    if limit:  # only languages above per_language rows
        share = F.create_map(*[F.lit(x) for n in limit.items() for x in n])
        known = known.filter(F.pmod("h", F.lit(1_000_003)) < F.coalesce(F.element_at(share, F.col("declared")), F.lit(1_000_003)))
    # each different text once, so that one text's copies do not make the model; only texts that may repeat are moved
    known = marked(known, "h", known.groupBy("declared", "h").count().filter("count > 1"))
    once, again = (known.filter(c).select("declared", "text") for c in ("not __may", "__may"))
    known = once.unionByName(again.dropDuplicates(["declared", "text"]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        held: dict[int, list[np.ndarray]] = {}
        n = 0

        def count() -> Iterator[pa.RecordBatch]:
            for k, cells in held.items():
                if k not in total:
                    if len(total) >= 64:  # the counts of so many languages are held at a time
                        yield from flush()
                    total[k] = np.zeros(CELLS, np.int64)
                total[k] += np.bincount(np.concatenate(cells), minlength=CELLS)
            held.clear()

        def flush() -> Iterator[pa.RecordBatch]:
            for k, t in total.items():
                at = np.flatnonzero(t)
                yield pa.RecordBatch.from_arrays([pa.array(at + k * CELLS), pa.array(t[at])], ["cell", "n"])
            total.clear()

        for b in slices(batches):
            for d, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                cells = trigrams(t)
                held.setdefault(place[d], []).append(cells)
                n += len(cells)
                if n >= COUNTED:
                    yield from count()
                    n = 0
        yield from count()
        yield from flush()

    counts = known.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = write_table(counts, "op6-counts", scratch)
    total, seen = counts.agg(F.sum("n"), F.count_distinct(F.col("cell") % CELLS)).first()
    if (total or 0) < support:
        return Models([], None, 2)
    return Models(names, counts, max(seen, 2))


def text_evidence(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """id, declared, host, suffix, th, n, ll: the text's hash and the log likelihoods of the whole text."""
    width = table.shape[1]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, ll = [], np.zeros((b.num_rows, width))
            for i, t in enumerate(utf8(b.column(5))):
                cells = trigrams(t)
                n.append(len(cells))
                for s in range(0, len(cells), 1 << 16):
                    ll[i] += table[cells[s : s + (1 << 16)]].sum(axis=0, dtype=np.float64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(n) + 1) * width, width), pa.int32()), pa.array(ll.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(n, pa.int64()), lists], ["id", "declared", "host", "suffix", "th", "n", "ll"])

    narrow = rows.select("id", "declared", "host", "suffix", F.xxhash64("text").alias("th"), "text")
    return narrow.mapInArrow(run, "id long, declared string, host string, suffix string, th long, n long, ll array<double>")


def counts_by(voted: DataFrame, key: Column, begin: int, width: int) -> DataFrame:
    """(key, c, total): how many rows of each key have each text language of a block, and any; nulls and empty keys are left out."""
    per = voted.select(key.alias("key"), "vote").filter("key is not null and key <> ''").groupBy("key", "vote").count()
    inside = (F.col("vote") >= begin) & (F.col("vote") < begin + width)
    pairs = F.collect_list(F.when(inside, F.struct(F.col("vote") - begin, "count")))  # of each key so many at most
    per = per.groupBy("key").agg(F.map_from_entries(pairs).alias("m"), F.sum("count").cast("double").alias("total"))
    return per.select("key", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")).alias("c"), "total")


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def smoothed(counts: Column, total: Column, prior: Column, strength: float) -> Column:
    """(counts + strength * prior) / (total + strength), by element."""
    return F.zip_with(counts, prior, lambda c, p: (c + p * strength) / (total + strength))


def host_priors(voted: DataFrame, overall: list[float], begin: int, strength: float) -> DataFrame:
    """(host, prior): each host's language shares, smoothed by its domain's, its suffix's and the overall ones; of a block."""
    top, width = F.array(*[F.lit(float(x)) for x in overall]), len(overall)
    host, dots = F.col("host"), F.size(F.split("host", r"\."))
    domain, suffix = F.when(dots > 2, F.substring_index(host, ".", -2)), F.when(dots > 1, F.substring_index(host, ".", -1))
    total = F.col("total")
    by_suffix = counts_by(voted, suffix, begin, width).select(F.col("key").alias("suffix"), smoothed(F.col("c"), total, top, strength).alias("ps"))
    by_domain = counts_by(voted, domain, begin, width).select(F.col("key").alias("domain"), F.col("c").alias("cd"), total.alias("td"))
    hosts = counts_by(voted, host, begin, width).select(F.col("key").alias("host"), "c", "total").withColumns({"domain": domain, "suffix": suffix})
    with_all = hosts.join(by_suffix, "suffix", "left").join(by_domain, "domain", "left")
    above = F.coalesce("ps", top)
    above = F.when(F.col("cd").isNull(), above).otherwise(smoothed(F.col("cd"), F.col("td"), above, strength))
    return with_all.select("host", smoothed(F.col("c"), total, above, strength).alias("prior"))


def evidence_table(voted: DataFrame, name: str, overall: list[float], begin: int, strength: float = 1.0) -> DataFrame:
    """(name, e): log P(value | language) for each value of a column and language of a block, from counts over all rows."""
    c = counts_by(voted, F.col(name), begin, len(overall))
    totals = F.array(*[F.lit(max(float(x), 1e-9)) for x in overall])
    return c.select(F.col("key").alias(name), F.zip_with("c", totals, lambda n, t: F.log((n + strength * t) / t)).alias("e"))


#: What a row is known by; rows alike in it have the same evidence.
ROW = ["id", "th", "declared", "host", "suffix"]


def put_together(blocks: list[DataFrame], columns: list[str], best: str, *more: str) -> DataFrame:
    """One row for each of ``columns`` in all blocks: the first highest ``best``, what goes with it, and n of a row.

    ``mass``, a sum of exponentials below each block's best, is carried to the highest one.
    """
    every = functools.reduce(DataFrame.union, [b.withColumn("block", F.lit(k)) for k, b in enumerate(blocks)])
    top = F.max_by(F.struct(best, *more), F.struct(F.col(best), -F.col("block"))).alias("t")
    masses = F.collect_list(F.struct(F.col(best), F.col("mass"))).alias("masses") if "mass" in every.columns else F.lit(None).alias("masses")
    found = every.groupBy(*columns).agg(top, masses)
    if "mass" in every.columns:  # a number for each block
        found = found.withColumn("mass", _sum(F.transform("masses", lambda m: m["mass"] * F.exp(m[best] - F.col("t")[best]))))
    return found.drop("masses").select(*columns, "t.*", *["mass"] * ("mass" in every.columns))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text: Column | None = None, declared: Column | None = None, host: Column | None = None, suffix: Column | None = None, per_language: int | None = None, support: int = 20, strength: float = 20.0, tempered: float = 100.0, least: float = 0.5, scratch: list[DataFrame] | None = None) -> DataFrame:
    """(id_col, th, declared, language, posterior, n_trigrams, kept) for every row; th: the hash of its text."""
    null = F.lit(None).cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.lower(declared if declared is not None else null).alias("declared"), F.lower(host if host is not None else null).alias("host"), F.lower(suffix if suffix is not None else null).alias("suffix"), (text if text is not None else F.col("text")).cast("string").alias("text"))
    own_scratch: list[DataFrame] = [] if scratch is None else scratch
    models = train(rows, per_language, support, own_scratch)
    tempering = F.col("n") / (1 + F.col("n") / tempered) / F.greatest(F.col("n"), F.lit(1))
    evidence, votes = [], []
    for begin, end in models.blocks:
        table = write_table(text_evidence(rows, models.table(begin, end)), "op6-evidence", own_scratch)
        found = table.withColumn("text_ll", F.transform("ll", lambda x: x * tempering))
        evidence.append(found)
        best = F.array_max("text_ll")
        votes.append(found.filter("n > 0").select(*ROW, best.alias("best"), (F.array_position("text_ll", best).cast("int") - 1 + begin).alias("vote")))
    if len(votes) == 1:
        voted = votes[0]
    else:  # a text has one vote, its rows are those of any block
        per_text = put_together([v.select("th", "best", "vote").dropDuplicates(["th"]) for v in votes], ["th"], "best", "vote")
        voted = write_table(join_split(votes[0].drop("best", "vote"), per_text.select("th", "vote"), ["th"]), "op6-votes", own_scratch)
    shares = {r[0]: r[1] for r in voted.groupBy("vote").count().collect()}  # a row for each language
    total, classes = sum(shares.values()), len(models.names) + 1
    scored = []
    for (begin, end), found in zip(models.blocks, evidence):
        names = models.classes(begin, end)
        width = len(names)
        overall = [(shares.get(begin + i, 0) + 1.0) / (total + classes) for i in range(width)]
        uniform = F.array(*[F.log(F.lit(x)) for x in overall])
        none = F.array(*[F.lit(0.0)] * width)
        d = write_table(evidence_table(voted, "declared", overall, begin), "op6-declared", own_scratch)
        s = write_table(evidence_table(voted, "suffix", overall, begin), "op6-suffix", own_scratch)
        p = write_table(host_priors(voted, overall, begin, strength), "op6-hosts", own_scratch)
        fused = found.join(d.withColumnRenamed("e", "ed"), "declared", "left").join(s.withColumnRenamed("e", "es"), "suffix", "left").join(p, "host", "left")
        score = F.zip_with("text_ll", F.coalesce(F.transform("prior", lambda x: F.log(x)), uniform), lambda a, b: a + b)
        score = F.zip_with(score, F.coalesce("ed", none), lambda a, b: a + b)
        score = F.zip_with(score, F.coalesce("es", none), lambda a, b: a + b)
        fused = fused.withColumn("score", score).withColumn("best", F.array_max("score"))
        fused = fused.withColumn("at", F.array_position("score", F.col("best")).cast("int")).withColumn("mass", _sum(F.transform("score", lambda x: F.exp(x - F.col("best")))))
        scored.append(fused.select(*ROW, "n", "best", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("at")).alias("language"), "mass"))
    if len(scored) == 1:
        fused = scored[0]
    else:  # rows alike are one, and come back as many as they were
        blocks = [b.groupBy(*ROW).agg(F.first("n").alias("n"), F.first("best").alias("best"), F.first("language").alias("language"), F.first("mass").alias("mass"), F.count("*").alias("copies")) for b in scored]
        fused = put_together(blocks, ROW, "best", "n", "language", "copies")
        chunks = F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / 1000)))
        fused = fused.withColumn("chunk", chunks).repartition("chunk", *ROW).withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("copies") - F.col("chunk") * 1000, F.lit(1000)))))
    posterior = 1.0 / F.col("mass")
    language = F.when(F.col("n") > 0, F.col("language")).otherwise(UNKNOWN)
    fused = fused.select(F.col("id").alias(id_col), "th", "declared", language.alias("language"), F.when(F.col("n") > 0, posterior).otherwise(0.0).alias("posterior"), F.col("n").alias("n_trigrams"), posterior.alias("__p"))
    kept = (F.col("language") != UNKNOWN) & (F.col("__p") >= least)
    return fused.withColumn("kept", kept).drop("__p")


def identify(docs: DataFrame, id_col: str = "doc_id", *args, **options) -> DataFrame:
    """(id_col, declared, language, posterior, n_trigrams, kept) for every row; see :func:`verdicts`."""
    return verdicts(docs, id_col, *args, **options).select(id_col, "declared", "language", "posterior", "n_trigrams", "kept")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: the declared language is ``lang``, the host is ``source``."""
    return identify(read(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


#: Elements whose content is no text, and comments; one that isn't closed runs to the end.
_HIDDEN = r"(?is)<(?:script\b.*?(?:</script\s*+>|\z)|style\b.*?(?:</style\s*+>|\z)|!--.*?(?:-->|\z))"


def page_text(html: Column) -> Column:
    """What stands outside of markup, tags and references being blanks; in time linear in the page.

    Behind the last > nothing is a tag; before it every < begins one.
    """
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    rest = F.substring_index(shown, ">", -1)
    tagged = F.left(shown, F.length(shown) - F.length(rest))
    return F.regexp_replace(F.concat(F.regexp_replace(tagged, r"(?s)<[^>]*+>", " "), rest), r"&#?\w++;", " ")


def page_language(html: Column) -> Column:
    """The first lang attribute of an html element, its letters before any other sign; empty without one."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<html\b[^>]*+"), F.lit(0))
    langs = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?is)\blang\s*+=\s*+["']?([A-Za-z]++)""", 1))
    return F.coalesce(F.get(F.filter(langs, lambda x: x != ""), F.lit(0)), F.lit(""))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: the html element's lang attribute, host and address suffix from the URL."""
    host = host_of(F.col("url"))
    return identify(read(spark, sf_dir, "pages"), id_col="page_id", text=page_text(F.col("html")), declared=page_language(F.col("html")), host=host, suffix=F.substring_index(host, ".", -1))


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", **columns: Column) -> DataFrame:
    """``docs`` without the rows whose language was rejected; a row is known by its id and the hash of its text.

    Rows alike in both, whose declared language or host may differ, stay if one of them does.
    """
    scratch: list[DataFrame] = []
    per = verdicts(docs, id_col, scratch=scratch, **columns).groupBy(F.col(id_col).alias("__out"), F.col("th").alias("__oth")).agg(F.max("kept").alias("kept"))
    # the few that go, not the many that stay: while they are small enough to broadcast, no text is moved
    out = write_table(per.filter("not kept").select("__out", "__oth"), "op6-rejected")
    drop_table(*scratch)
    text = columns.get("text")
    return without_rows(docs, out, id_col, text if text is not None else F.col("text"))
