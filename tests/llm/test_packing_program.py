"""The configuration program covers what it is asked to, and places most of the pieces."""

import re
from collections import Counter

import numpy as np
import pytest

from loomwork.llm import packing


def _lognormal(n, capacity=4096):
    x = np.ceil(np.random.default_rng(3).lognormal(6, 1.2, n)).astype(int) + 1
    x = np.minimum(x, capacity)
    return {int(a): int(b) for a, b in zip(*np.unique(x, return_counts=True))}


@pytest.fixture(scope="module")
def histogram():
    return _lognormal(35_000)


def test_program_covers_every_length(histogram):
    demand = np.zeros(4097, np.int64)
    for length, n in histogram.items():
        demand[length] = n
    demand[4096] = 0
    used = np.zeros(4097)
    for key, amount in packing.program(demand, 4096).items():
        assert sum(length * n for length, n in key) <= 4096 and amount > 0
        for length, n in key:
            used[length] += n * amount
    wanted = demand > 0
    assert (used[wanted] >= (1 - packing.EPSILON) * demand[wanted] * (1 - 1e-6)).all()
    assert (used <= demand * (1 + 1e-6)).all()


def test_program_places_most_pieces(histogram, caplog):
    """The program, not best fit, does the work, and not one sequence more than best fit needs."""
    caplog.set_level("INFO", "loomwork.llm.packing")
    plan = packing.solve(histogram, 4096)
    total = Counter()
    for config, times in plan:
        assert sum(length * n for length, n in config.items()) <= 4096 and times > 0
        for length, n in config.items():
            total[length] += n * times
    assert total == Counter(histogram)
    pieces, tokens = map(float, re.findall(r"\d\.\d+", caplog.messages[-1]))
    assert pieces > 0.9 and tokens > 0.9
    assert sum(times for _, times in plan) <= sum(times for _, times in packing.solve(histogram, 4096, rounds=0))
