"""Timeline operators against brute force, at several bucket widths."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cutline.operators import timeline as TL

BASE = dt.datetime(2024, 1, 1)


def _data(seed=7, n=220):
    rnd = random.Random(seed)
    # One key holds most rows, several instants are shared.
    key = lambda: "hot" if rnd.random() < 0.6 else f"k{rnd.randrange(4)}"
    right = [(key(), BASE + dt.timedelta(hours=rnd.randrange(300)), i, rnd.choice([None, i])) for i in range(n)]
    left = [(i, key(), BASE + dt.timedelta(hours=rnd.randrange(-5, 310))) for i in range(n)]
    return left, right


def _frames(spark, left, right):
    l = spark.createDataFrame(left, "id long, k string, t timestamp")
    r = spark.createDataFrame(right, "k string, at timestamp, seq long, v long")
    return l, r


@pytest.mark.parametrize("seconds", [3600, 86400, 30 * 86400])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_latest(spark, seconds, inclusive):
    left, right = _data()
    l, r = _frames(spark, left, right)
    got = {
        x.id: x.seq
        for x in TL.asof_latest(
            l, r, ["k"], "t", "at", ["seq", "v"], right_order=["seq"], inclusive=inclusive, bucket_seconds=seconds
        ).collect()
    }
    for i, k, t in left:
        seen = [(at, s) for rk, at, s, _ in right if rk == k and (at <= t if inclusive else at < t)]
        assert got[i] == (max(seen)[1] if seen else None)


@pytest.mark.parametrize("seconds", [3600, 86400, 30 * 86400])
@pytest.mark.parametrize("inclusive", [True, False])
def test_asof_next(spark, seconds, inclusive):
    left, right = _data(11)
    l, r = _frames(spark, left, right)
    got = {
        x.id: x.seq
        for x in TL.asof_next(
            l, r, ["k"], "t", "at", ["seq"], right_order=["seq"], inclusive=inclusive, bucket_seconds=seconds
        ).collect()
    }
    for i, k, t in left:
        seen = [(at, s) for rk, at, s, _ in right if rk == k and (at >= t if inclusive else at > t)]
        assert got[i] == (min(seen)[1] if seen else None)


@pytest.mark.parametrize("seconds", [7200, 30 * 86400])
def test_asof_totals_and_running_totals(spark, seconds):
    left, right = _data(3)
    l, r = _frames(spark, left, right)
    r = r.withColumn("one", F.lit(1))
    got = {x.id: (x.one, x.v) for x in TL.asof_totals(l, r, ["k"], "t", "at", ["one", "v"], bucket_seconds=seconds).collect()}
    for i, k, t in left:
        seen = [v for rk, at, _, v in right if rk == k and at <= t]
        assert got[i] == (len(seen), sum(v or 0 for v in seen))
    run = TL.running_totals(r, ["k"], "at", ["seq"], {"n": F.lit(1)}, bucket_seconds=seconds).collect()
    for x in run:
        assert x.n == sum(1 for rk, at, s, _ in right if rk == x.k and (at, s) <= (x["at"], x.seq))


@pytest.mark.parametrize("seconds", [3600, 30 * 86400])
def test_previous_row(spark, seconds):
    _, right = _data(5)
    _, r = _frames(spark, [(0, "a", BASE)], right)
    for x in TL.previous_row(r, ["k"], "at", ["seq"], ["seq", "v"], bucket_seconds=seconds).collect():
        earlier = [(at, s, v) for rk, at, s, v in right if rk == x.k and (at, s) < (x["at"], x.seq)]
        assert x.prev_exists == bool(earlier)
        assert (x.prev_seq, x.prev_v) == ((max(earlier, key=lambda e: e[:2])[1:]) if earlier else (None, None))


def test_latest_and_top(spark):
    _, right = _data(9)
    _, r = _frames(spark, [(0, "a", BASE)], right)
    for x in TL.latest_per_key(r, ["k"], ["at", "seq"]).collect():
        assert (x["at"], x.seq) == max((at, s) for rk, at, s, _ in right if rk == x.k)
    top = TL.top_per_key(r, ["k"], [F.desc("at"), F.desc("seq")], 3, salts=4, salt_on=["seq"]).collect()
    want = {k: sorted(((at, s) for rk, at, s, _ in right if rk == k), reverse=True)[:3] for k in {x[0] for x in right}}
    got = {}
    for x in sorted(top, key=lambda x: x.rank_in_key):
        got.setdefault(x.k, []).append((x["at"], x.seq))
    assert got == want


def test_suggested_width_shrinks_for_a_hot_key(spark):
    _, right = _data(2)
    _, r = _frames(spark, [(0, "a", BASE)], right)
    assert TL.suggest_bucket_seconds(r, ["k"], "at", max_rows=10) < TL.suggest_bucket_seconds(r, ["k"], "at", max_rows=100)
