import random

import pytest

from tests.conftest import SF

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(6000))


def _edge_cases():
    rng = random.Random(5)
    base = [f"word{rng.randrange(400)}" for _ in range(120)]
    near = base[:60] + ["changed"] + base[61:]
    far = base[:30] + [f"other{i}" for i in range(90)]
    passage = "This very passage, of well over a hundred bytes, stands in several documents, word for word, as it were, again."
    return [
        (90001, None), (90002, ""), (90003, "  \n\t "), (90004, "one two"), (90005, "One TWO"), (90006, " ".join(base)), (90007, " ".join(base)), (90008, " ".join(near)), (90009, " ".join(far)),
        (90010, LONG), (90011, LONG + " tail"), (90012, "a" * 500), (90013, "a" * 300), (90014, "x" * 40000), (90015, "before " + passage + " after"), (90016, "other " + passage + " end"), (90017, "é" * 99 + "b" * 130), (90018, "ü" * 99 + "b" * 130),
        (90019, "mail a.b@c.de and x@y.z.w card 4111 1111 1111 1111 and 4111111111111111 4012888888881881 ip 10.0.0.1 999.1.1.1 phone +1 (523) 555-1055 done"),
        (90020, "<|endoftext|> It's 'quoted' don't''ll <|startoftext|>x\x1cy\x85z　w ΑΣ İ ſ １2 日本"), (90021, "line\n" * 9 + "$$$ ### %%% &&& *** ||| <<<"), (None, "a" * 300), (None, None),
    ]


@pytest.fixture(scope="session")
def small(spark):
    """(rows, DataFrame): the smallest documents with edge cases, a null id among them, and columns
    whose names clash with those the operators use."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 120 and length(text) < 9000")
    rows = [(r[0], r[1], r[2]) for r in docs.collect()] + [(i, t, None if i is None else "en") for i, t in _edge_cases()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    for name in ("n", "block", "key", "rep", "label", "length", "held_out", "digest", "a b"):
        df = df.withColumn(name, F.lit("clash"))
    return [(i, t) for i, t, _ in rows], df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
