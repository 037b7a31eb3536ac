"""Odd radii: pairs at exactly that distance are linked, others are not."""

import random

import pytest

from cutline.llm import simhash as S


@pytest.mark.parametrize("radius", [1, 3])
def test_odd_radius(spark, radius):
    near, far = (1 << radius) - 1, (1 << 40) * ((1 << (radius + 1)) - 1)
    docs = spark.createDataFrame([(0,), (near,), (far,)], "fp long")
    assert [tuple(sorted(r)) for r in S.links(docs, radius).collect()] == [(0, near)]


@pytest.mark.parametrize("radius", [1, 3])
def test_crowds(spark, radius):
    """Components over the links against those over all pairs within the radius."""
    draw = random.Random(radius)
    fps = sorted({sum(1 << draw.randrange(0, 60, 7) for _ in range(draw.randint(0, 6))) & ((1 << 62) - 1) for _ in range(60)} | {draw.getrandbits(11) << 20 for _ in range(40)})
    near = lambda a, b: bin(a ^ b).count("1") <= radius

    def roots(pairs):
        root = {x: x for x in fps}
        for _ in fps:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    found = [tuple(r) for r in S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius).collect()]
    assert roots(found) == roots([(a, b) for a in fps for b in fps if a < b and near(a, b)])
