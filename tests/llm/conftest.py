import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """Rows with every odd case: nulls, empty and long texts, repeated ids and rows, further columns."""

    def make(rows):
        out = spark.createDataFrame([(i, t, lang, "id", "x") for i, t, lang in rows], "doc_id long, text string, lang string, id string, ord string")
        return out.repartition(3, "text")

    return make


def words(n, seed=0, pool=500):
    import random

    r = random.Random(seed)
    return [f"{r.choice('abcdefgh')}{r.randrange(pool)}" for _ in range(n)]
