import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from texts or (id, text) pairs, with nulls where asked, and an extra column of a clashing name."""

    def build(rows, extra=None):
        full = []
        for i, r in enumerate(rows):
            i, t = r if isinstance(r, tuple) else (i, r)
            full.append((i, t, "en" if t else None, "s1" if t else None, len(t) if t else None))
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit("mine") for c in extra})
        return df.repartition(3)

    return build


@pytest.fixture(scope="session")
def words():
    """Repeatable invented prose."""
    import random

    syllables = [a + b for a in "b d f g k l m n p r s t v z".split() for b in "a e i o u an er".split()]

    def text(n, seed):
        rng = random.Random(seed)
        out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n)]
        for i in range(9, n, 10):
            out[i] += "."
        return " ".join(out)

    return text
