"""Small tables with every awkward row: nulls, empty and long texts, repeated rows, clashing extra columns."""
from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, score string, key int, hits string, class_id int"


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["an", "the", "ro", "ki", "mu", "sol", "ber", "ta"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def awkward(spark, texts=None):
    """Rows of (doc_id, text) with extra columns whose names the operators use themselves."""
    long = prose(99, 60_000)
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (3, None), (4, ""), (5, " \t\n "), (6, "a"), (7, "  a \n"), (None, prose(1, 60)), (None, None),
            (8, long), (9, long + " tail"), (10, "ÉÈ ñ 日本"), (10, "ÉÈ ñ 日本"), (11, prose(2, 60))] if texts is None else texts
    return spark.createDataFrame([(i, t, "x", 5, "h", -1) for i, t in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(rows, column):
    return {r["doc_id"]: r[column] for r in rows if r["doc_id"] is not None}
