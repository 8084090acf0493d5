from __future__ import annotations

import random

import pytest
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark: SparkSession):  # noqa: ANN201
    def rows(*texts: str | None, ids: list[int | None] | None = None, **columns: list) -> DataFrame:
        ids = list(range(len(texts))) if ids is None else ids
        lang = columns.get("lang", ["en"] * len(texts))
        source = columns.get("source", ["s0"] * len(texts))
        data = [(i, t, la, so, None if t is None else len(t)) for i, t, la, so in zip(ids, texts, lang, source, strict=True)]
        return spark.createDataFrame(data, SCHEMA).repartition(3)

    return rows


WORDS = "an the quick brown foxes jump over lazy dogs while seven wizards brew tea né über ñandú 東京".split()


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


#: Null, empty, white space, one word, ties and repeats, astral characters, a long text.
EDGES = [None, "", " \t\n", "one", "one", prose(4, 1), prose(300, 2), prose(300, 2), prose(300, 2) + " tail", "🙂 " * 40, "x" * 3000, prose(20_000, 3)]
