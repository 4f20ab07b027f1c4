"""The counter folded by guessing against one fold over all samples."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.operators import uses


def in_order(samples):
    """(pos, topic) of each sample, one after the other."""
    count, out = {}, []
    for rows in samples:
        pos, _, topic = max(rows, key=lambda r: (r[1] - 3 * count.get(r[2], 0), -r[0]))
        count[topic] = count.get(topic, 0) + 1
        out.append((pos, topic))
    return out


def made(rnd, n, topics, rare=0.1):
    """Samples of which a few topics are rarely possible, and others only in one stretch."""
    out = []
    for k in range(n):
        able = [t for j, t in enumerate(topics) if rnd.random() < (rare if j % 4 == 3 else 0.8) and (j % 4 != 2 or k * 3 // n == j % 3)] or [topics[0]]
        out.append([(p, rnd.randint(2, 5), t) for p, t in enumerate(rnd.sample(able, len(able)))])
    return out


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 9), st.integers(1, 12))
def test_settles_on_the_order_of_all(seed, n, parts, topics):
    rnd = random.Random(seed)
    samples = made(rnd, n, [f"t{k}" for k in range(topics)], rnd.random())
    cuts = sorted(rnd.randint(0, n) for _ in range(parts - 1))
    ranges = [samples[a:b] for a, b in zip([0, *cuts], [*cuts, n], strict=True)]

    def fold(guesses):
        got = {}
        for k, g in guesses.items():
            f = uses.Fold(g)
            for rows in ranges[k]:
                f.choose(rows)
            got[k] = (f.picked, f.margin, f.passed)
        return got
    starts, rounds = uses.settle(fold, parts)
    out = []
    for g, part in zip(starts, ranges, strict=True):
        f = uses.Fold(g)
        out += [f.choose(rows) for rows in part]
    assert out == in_order(samples) and rounds <= parts + 1


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_on_spark(spark, parts):
    samples = made(random.Random(9), 3000, [f"t{k}" for k in range(13)])
    rows = [("c" + str(k * 5 // 3000), k, f"s{k:05d}", p, t, x) for k, q in enumerate(samples) for p, x, t in q]
    df = spark.createDataFrame(rows, "city string, ord int, sample_id string, pos int, topic string, score int").repartition(6)
    got = sorted(map(tuple, uses.best_questions_in_order(df, parts).collect()))
    assert got == [(f"s{k:05d}", *r) for k, r in enumerate(in_order(samples))]
    assert uses.best_questions_in_order(df.limit(0), parts).count() == 0


def test_few_rounds():
    """Ranges of some hundred samples settle in a few rounds, however many there are."""
    samples = made(random.Random(2), 40_000, [f"t{k}" for k in range(13)], 0.3)
    ranges = [samples[k : k + 400] for k in range(0, 40_000, 400)]
    folded = 0

    def fold(guesses):
        nonlocal folded
        folded += len(guesses)
        got = {}
        for k, g in guesses.items():
            f = uses.Fold(g)
            for rows in ranges[k]:
                f.choose(rows)
            got[k] = (f.picked, f.margin, f.passed)
        return got
    _, rounds = uses.settle(fold, 100)
    assert rounds <= 15 and folded <= 500
