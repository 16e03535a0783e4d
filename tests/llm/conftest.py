import random

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def frame(spark):
    """A documents-like frame with columns whose names the operators use inside."""

    def make(rows, schema="doc_id long, text string"):
        out = spark.createDataFrame(rows, schema)
        for name in ("h", "n", "key", "key_", "k0", "band", "size", "place", "v", "kind", "part", "node", "component", "row", "count", "words"):
            out = out.withColumn(name, F.lit(name))
        return out

    return make


@pytest.fixture
def prose():
    """Texts of few words, so that runs repeat: copies, near copies, shared passages, odd shapes."""

    def make(seed, n, vocabulary=40, low=1, high=60):
        rng = random.Random(seed)
        words = [f"w{k}" for k in range(vocabulary)] + ["É", "ß,"]
        texts = []
        for _ in range(n):
            kind = rng.random()
            if texts and kind < 0.2:
                texts.append(rng.choice(texts))
            elif texts and kind < 0.45:
                own = (rng.choice(texts) or "").split(" ")
                for _ in range(rng.randint(1, 3)):
                    own[rng.randrange(len(own))] = rng.choice(words)
                texts.append(" ".join(own))
            elif texts and kind < 0.55:
                texts.append((rng.choice(texts) or "") + rng.choice([" ", "\n"]) + " ".join(rng.choices(words, k=rng.randint(1, 30))))
            else:
                texts.append(rng.choice([" ", "  ", "\n"]).join(rng.choices(words, k=rng.randint(low, high))))
        return [*texts, None, "", "  \n\t ", " ".join(words * 40)]

    return make
