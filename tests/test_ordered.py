"""Global order in ranges, and fronts by a grid, against plain Python."""

import contextlib
import io
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import corpus, ordered, pareto, relations


def plan_of(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_ranks_and_neighbours(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randrange(40)), rng.choice("abc")) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, v double, s string").repartition(7)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    for ranges in (1, 3, 40):
        got = {r["id"]: r["rank"] for r in ordered.ranked(df, ["v", "id"], ranges=ranges).collect()}
        assert got == {r[0]: i + 1 for i, r in enumerate(order)}
        near = ordered.with_neighbours(df, ["v", "id"], ["v", "s"], ranges)
        found = {r["id"]: (r["before_v"], r["before_s"], r["after_v"], r["after_s"]) for r in near.collect()}
        none = (None, None, None)
        assert found == {r[0]: (*(order[i - 1] if i else none)[1:], *(order[i + 1] if i + 1 < len(order) else none)[1:]) for i, r in enumerate(order)}
        assert near.columns == [*df.columns, "before_v", "after_v", "before_s", "after_s"]
    assert ordered.ranked(df.limit(0), ["v", "id"]).count() == ordered.with_neighbours(df.limit(0), ["v", "id"], ["v"]).count() == 0


def test_order_has_no_window_over_all_rows(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "id int, v double")
    for out in (ordered.ranked(df, ["v", "id"]), ordered.with_neighbours(df, ["v", "id"], ["v"]), pareto.crowding_distance(df, ["v"], [(0, 9)], "id"), corpus.limited(df.withColumnRenamed("id", "doc_id"), 20)):
        plan = plan_of(out)
        assert "SinglePartition" not in plan or "GlobalLimit" in plan
        assert "TakeOrderedAndProject" not in plan
    pairs = spark.createDataFrame([("a", "b", 3), ("c", "d", 9)], "w1 string, w2 string, fitness long")
    assert "SinglePartition" not in plan_of(relations.ranked(pairs))


@settings(max_examples=12, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-9, 9), st.sampled_from([-(1 << 63), (1 << 63) - 1, 1 << 40])), min_size=1, max_size=30), st.integers(0, 34))
def test_first_rows_of_any_keys(spark, keys, n):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "doc_id long, i int")
    got = [r["doc_id"] for r in corpus.limited(df, n).collect()]
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    assert sorted(got, key=lambda k: (k is not None, k or 0)) == order[:n]


def test_limits(spark):
    df = spark.range(5000).withColumnRenamed("id", "doc_id").repartition(9)
    assert sorted(r[0] for r in corpus.limited(df, 1234, compat_limit=True).collect()) == list(range(1233))
    assert corpus.limited(df, None).count() == 5000 and corpus.limited(df, 0).count() == corpus.limited(df, 1, True).count() == 0
    assert corpus.limited(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("dims", [1, 2, 3, 4])
def test_grid_gives_the_front(spark, monkeypatch, dims):
    monkeypatch.setattr(pareto, "PER_CELL", 20)
    monkeypatch.setattr(pareto, "BLOCK", 16)
    rng = np.random.default_rng(dims)
    points = rng.integers(0, 12, (400, dims)).astype(float)
    points[:60] = 11 - rng.integers(0, 3, (60, dims))
    sphere = rng.random((300, dims)) + 1e-3
    points = np.vstack([points, 20 * sphere / np.linalg.norm(sphere, axis=1, keepdims=True), [[np.nan] * dims, [np.inf] + [-np.inf] * (dims - 1)]])
    up = [i % 2 == 0 for i in range(dims)]
    signed = points * np.where(up, 1, -1)
    rows = [(i, *map(float, p)) for i, p in enumerate(points)] + [(9999, *[None] * dims)]
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"{n} double" for n in names)).repartition(6)
    beats = lambda q, p: (q >= p).all() and (q > p).any()
    want = {i for i, p in enumerate(signed) if not any(beats(q, p) for q in signed)} | {9999}
    front = pareto.pareto_front(df, names, up)
    assert {r["id"] for r in front.collect()} == want and "NestedLoop" not in plan_of(front)
    assert pareto.pareto_front(df.limit(0), names, up).count() == 0


def test_a_front_of_100000_points(spark):
    x = np.arange(100_000) / 100_000
    rows = np.vstack([np.stack([x, 1 - x, np.arange(len(x))], 1), np.stack([x * 0.9, 0.9 - 0.9 * x, np.arange(len(x)) + len(x)], 1)])
    df = spark.createDataFrame(rows.tolist(), "a double, b double, i double").repartition(8)
    front = pareto.pareto_front(df, ["a", "b"], [True, True])
    assert front.count() == 100_000 and front.agg({"i": "max"}).first()[0] < 100_000
