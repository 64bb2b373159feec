"""The pipeline's near_dups stage against brute force at its own threshold of 80 per cent."""

import random

import pytest

import corpus_pipeline as P
from loomwork.llm import minhash
from tests.llm import brute


def _components(docs, percent):
    sets = {i: brute.shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return brute.components(ids, links)


def _rows():
    """Copies with 0 to 5 words in 150 changed, and short texts of 3 to 7 shingles."""
    rng, rows = random.Random(8), []
    for g in range(12):
        base = [f"g{g}w{i}" for i in range(150)]
        for e in range(6):
            w = list(base)
            for k in rng.sample(range(10, 140), e):
                w[k] = f"e{rng.randrange(10**6)}"
            rows.append((100 * g + e, " ".join(w)))
        short = [f"s{g}x{i}" for i in range(12)]
        rows += [(100 * g + 10 * n, " ".join(short[: n + 4])) for n in range(3, 8)] if g % 2 else [(100 * g + 30, " ".join(short[:8])), (100 * g + 40, " ".join(short[:9]))]
    return rows


def test_stage_drops_pairs_of_80_per_cent(spark):
    rows = _rows()
    want, at_85 = _components(rows, 80), _components(rows, 85)
    assert set(want.values()) < set(at_85.values())
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema).repartition(3)
    assert {r["doc_id"] for r in P.near_dups(spark, docs, "").collect()} == set(want.values())
    op5 = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert op5 == at_85


@pytest.mark.parametrize("threshold, least, agree", [(85, 6, 0.70), (80, 4, 0.64)])
def test_bounds_follow_the_threshold(threshold, least, agree):
    assert minhash.least_shingles(threshold) == least
    assert 100 * least >= threshold * (least + 1) and 100 * (least - 1) < threshold * least
    assert minhash.min_agree(threshold) == agree


def test_planted_pairs_near_the_threshold_are_all_found(spark):
    """Recall on 300 pairs whose Jaccard similarity lies between 0.85 and 0.90."""
    import numpy as np

    rng, rows, want = random.Random(21), [], 0
    for g in range(300):
        base = [f"p{g}w{i}" for i in range(240)]
        w = list(base)
        for k in range(1, 1 + rng.choice((2, 3, 3))):
            w[56 * k - rng.randrange(40)] = f"n{rng.randrange(10**9)}"
        x, y = brute.shingles(" ".join(base)), brute.shingles(" ".join(w))
        if not 0.85 <= len(x & y) / len(x | y) <= 0.95:
            continue
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w))]
        want += 1
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want > 150 and np.mean([got[i] == i - i % 2 for i, _ in rows]) == 1.0
