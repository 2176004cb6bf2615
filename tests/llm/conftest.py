import pytest

#: Columns that clash with names the operators use inside.
CLASH = ["_id", "_n", "_bin", "list", "node", "component", "key", "sig", "kind", "pid", "_host", "__pb_lines", "n", "score", "shard"]


@pytest.fixture(scope="session")
def make(spark):
    """Documents with every column of the table, and extra ones of clashing names."""
    from pyspark.sql import functions as F

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(partitions)
        return df.withColumns({c: F.lit("clash") for c in CLASH})

    return build


@pytest.fixture(scope="session")
def words():
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    return lambda n, seed: random.Random(seed).choices(vocabulary, k=n)
