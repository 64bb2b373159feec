"""The pipeline's stages against plain definitions of what each must keep."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from loomwork.llm.common import materialize
from tests.conftest import SF
from tests.llm import brute


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["documents"] = docs
    for name, f in P.STAGES:
        docs = out[name] = materialize(f(spark, docs, SF), name)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns


def test_quality_drops_failures(stages):
    before, after = texts(stages["documents"]), texts(stages["quality"])
    for i, t in before.items():
        n, _, _, _, r = brute.quality_counts(t)
        if n < 20 or 100 * r > 30 * n:
            assert i not in after
    assert len(after) > 0.6 * len(before)


def test_one_of_each_group_stays(stages):
    before = texts(stages["quality"])
    _, comps = brute.near_duplicates(list(before.items()), P.NEAR)
    assert set(texts(stages["near_dups"])) == set(comps.values())


def test_repeats_go(stages):
    before, after = texts(stages["near_dups"]), texts(stages["repeats"])
    want = brute.repeats(list(before.items()))
    for i, t in after.items():
        assert len(before[i].encode()) - want[i][1] >= len(t.encode()) >= len(before[i].encode()) - want[i][1] - 6 * want[i][2]
    assert stages["repeats"].where(F.col("n_chars") != F.length("text")).count() == 0


def test_personal_data_goes(stages):
    before = texts(stages["repeats"])
    assert any(brute.pii(t) for t in before.values())
    for i, t in texts(stages["private"]).items():
        assert before[i] == t or brute.pii(before[i]) or "[" in t
        for s, k, e in brute.pii(before[i]):
            assert before[i][s:e] not in t or k == 1


def test_all_is_packed(stages, spark):
    packed = stages["packed"]
    assert packed.select("doc_id").distinct().count() == stages["private"].count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_empty_and_odd_documents(spark, tmp_path):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "x y z " * 3, "en", "s", 9), (2, "", "en", "s", 0), (3, " ".join(f"w{i}" for i in range(50)), None, None, 5), (3, " ".join(f"w{i}" for i in range(50)), None, None, 5)], schema)
    for docs_in in (odd, odd.limit(0)):
        docs = docs_in
        for name, f in P.STAGES:
            docs = materialize(f(spark, docs, SF), name)
        assert docs.count() == (2 if docs_in is odd else 0)  # of equal rows the second keeps its end id alone


def test_exact_rows_of_a_small_corpus(spark, tmp_path):
    """Nulls, junk, copies, a shared passage, personal data, a very long text, rows that repeat and
    columns whose names the operators use themselves: what run() must return, piece by piece."""
    import random
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(5)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n))
    first, passage, long_ = fresh(60), fresh(40), fresh(30_000)
    rows = [
        (1, first), (2, first), (3, first.replace(first.split()[30], "changed", 1)), (4, "x" + passage + fresh(40)), (5, fresh(40) + "y" + passage + "z " + fresh(10)),
        (6, fresh(30) + " mail a.b@c.example.org now"), (7, long_), (8, None), (9, ""), (10, "too few words"), (11, "same words " * 40), (12, fresh(50)), (12, fresh(50)),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), True, 7, "r", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean, component_id int, row string, block double")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [(i, t) for i, t in rows if i in (1, 4, 5, 6, 7, 12)]
    cut_at = dict(kept)[5].encode().index(passage.encode())
    text = {i: t for i, t in kept}
    text[5] = text[5][:cut_at] + text[5][cut_at + len(passage) :]
    text[6] = text[6].replace("a.b@c.example.org", "[email]")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in kept:
        ids = library.encode(t if i == 12 else text[i], add_special_tokens=False).ids + [1]
        want += [(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)]
    got = P.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert len({r["sequence_id"] for r in got}) <= -(-sum(x[3] for x in want) // 4096) + 1
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == docs.columns
