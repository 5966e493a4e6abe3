import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = ["alpha", "Beta", "gamma", "delta", "Eps", "zeta", "eta", "théta", "iota", "kappa", "λ", "mu", "nu", "xi", "omicron", "pi"]
# names that the operators use for columns of their own
CLASHING = ["component_id", "fingerprint", "hash", "lines", "words", "key_id", "key_text", "id", "node", "length", "pack_bucket", "doc"]


def sentence(rng: random.Random, size: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 40)) * (rng.random() < 0.3) for _ in range(size)).capitalize() + "."


def prose(rng: random.Random, lines: int) -> str:
    return "\n".join(" ".join(sentence(rng, rng.randint(3, 18)) for _ in range(rng.randint(1, 4))) for _ in range(lines))


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    """Ids and texts: prose, exact and near copies, repeated rows, nulls, empty and very long texts."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(1, 12)) for _ in range(40)]
    rows = [(i, text) for i, text in enumerate(base)]
    rows += [(100 + i, base[i]) for i in range(5)]
    rows += [(110 + i, base[10].replace("a", "o", i + 1)) for i in range(4)]
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one"), (204, "one two"), (205, "\n\n"), (205, "\n\n")]
    rows += [(206, prose(rng, 4000)), (207, "same " * 30_000), (208, "x" * 50_000)]
    rows += [(3, base[3]), (None, base[4]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with extra columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"),
                     F.length("text").cast("long").alias("n_chars"), *[F.lit(1).alias(name) for name in CLASHING]).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
