import random

import pytest

EXTRA = "size long, copies long, v double, node long, component long, block long, lines string, n long, kept boolean, score double, row long, base string, found string, token_ids string, n_tokens string, n_ip string, e double, digest string, licence string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["the", "thonor", "anting", "reed", "ble,", "éçore", "über", "lyes.", "Onand", "hation"]) + (str(r.randrange(9)) if r.random() < 0.02 else "") for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared lines, nulls, empty and long ones; ids with gaps; a null id."""
    r = random.Random(7)
    base = [prose(r, r.randrange(12, 120)) for _ in range(40)]
    rows = [(k, "\n".join((t, prose(r, 30))), "en", f"src{k % 3}", 1) for k, t in enumerate(base)]
    rows += [(100 + k, base[k], None, None if k % 2 else "src0", None) for k in range(10)]
    rows += [(200 + k, rows[k % 4][1], "en", "src0", 1) for k in range(12)]
    for k in range(20):
        w = rows[k % 5][1].split(" ")
        w[r.randrange(len(w))] = "changed"
        rows.append((300 + k, " ".join(w), "en", "src1", 1))
    rows += [(400, None, None, None, None), (401, "", "en", "src1", 0), (402, " \n\t ", "en", "src2", 3), (403, "one two", "en", "src2", 7), (404, "ONE two", "en", "src2", 7), (405, prose(r, 30_000), "en", "src0", 1), (406, "x" * 70_000, "en", "src1", 1), (None, base[0], "en", "src1", 1)]
    return rows + [(500, "again and again one two three four five six seven", "en", "src2", 1)] * 3


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with many more columns, all null."""
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructType

    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(EXTRA)]).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
