"""Fingerprint links equal all pairs, whether a segment's value is held by few fingerprints or by most of them."""

from __future__ import annotations

import random

import pytest

from tallyloom.llm import simhash
from tallyloom.llm.common import components


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def values_around(seed: int) -> list[int]:
    """Neighbours at one to four bits, and a hot value in either segment with the other bits at random."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1}
    for half in (0, 32):
        base, hot = rng.getrandbits(64), rng.getrandbits(32)
        for _ in range(120):
            value = hot << half | rng.getrandbits(6) << (32 - half)
            out |= {value, value ^ 1 << rng.randrange(64)}
        for _ in range(60):
            value = base
            for _ in range(rng.randint(0, 4)):
                value ^= 1 << rng.randrange(64)
            out |= {value, rng.getrandbits(64)}
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 5, 1000])
def test_links_equal_all_pairs(spark, hot):
    values = values_around(hot)
    frame = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    pairs = {d: {frozenset((signed(a), signed(b))) for a in values for b in values if a < b and (a ^ b).bit_count() <= d} for d in (1, 2)}
    assert {frozenset((r.a, r.b)) for r in simhash.links(frame, 1, hot).collect()} == pairs[1]
    found = [frozenset((r.a, r.b)) for r in simhash.links(frame, 2, hot).collect()]
    assert len(found) == len(set(found)) and set(found) <= pairs[2]
    if hot == 1000:
        assert set(found) == pairs[2]

    root = {signed(v): signed(v) for v in values}

    def find(node):
        while root[node] != node:
            node = root[node]
        return node

    for a, b in map(tuple, pairs[2]):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = {r.node: r.root for r in components(simhash.links(frame, 2, hot)).collect()}
    assert {v: got.get(v, v) for v in root} == {v: find(v) for v in root}
    assert len(set(got.values())) > 2


def test_a_distance_beyond_two_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp long"), 3)
