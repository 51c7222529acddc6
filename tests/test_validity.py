import math

import numpy as np

from parcelwatt.operators import spatial, validity


def box(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


SHAPES = {
    "square": ([box(0, 0, 4)], None),
    "repeated point": ([[(0, 0), (0, 0), (4, 0), (4, 4), (0, 0)]], None),
    "bow-tie": ([[(0, 0), (4, 3), (4, 0), (0, 4), (0, 0)]], "crossing"),
    "spike": ([[(0, 0), (4, 0), (6, 0), (4, 0), (4, 4), (0, 0)]], "crossing"),
    "touches itself": ([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]], "crossing"),
    "corner twice": ([[(0, 0), (2, 2), (4, 0), (4, 4), (2, 2), (0, 4), (0, 0)]], "crossing"),
    "hole": ([box(0, 0, 4), box(1, 1, 1)], None),
    "hole touches the shell": ([box(0, 0, 4), [(0, 2), (1, 1), (1, 3), (0, 2)]], None),
    "hole crosses": ([box(0, 0, 4), box(3, 1, 2)], "rings"),
    "hole shares a side": ([box(0, 0, 4), box(0, 1, 2)], "rings"),
    "hole outside": ([box(0, 0, 4), box(5, 5, 1)], "hole"),
    "hole in a hole": ([box(0, 0, 9), box(1, 1, 5), box(2, 2, 1)], "hole"),
    "holes touch": ([box(0, 0, 9), box(1, 1, 2), box(3, 3, 2)], None),
    "open": ([box(0, 0, 4)[:-1]], "ring"),
    "flat": ([[(0, 0), (1, 1), (2, 2), (0, 0)]], "ring"),
    "not a number": ([[(0, 0), (math.nan, 0), (4, 4), (0, 0)]], "ring"),
    "null corner": ([[(0, 0), None, (4, 4), (0, 0)]], "ring"),
    "no ring": ([], "empty"),
    "null": (None, "empty"),
}
SCHEMA = "name string, rings array<array<struct<x:double,y:double>>>, valid string"


def typed(rings):
    return rings and [[p and tuple(map(float, p)) for p in r] for r in rings]


def test_reasons(spark):
    rows = [(n, typed(r), "x") for n, (r, _) in SHAPES.items()]
    got = validity.validity(spark.createDataFrame(rows + rows[:3], SCHEMA)).collect()
    assert len(got) == len(rows) + 3
    assert {r["name"]: r.reason for r in got} == {n: why for n, (_, why) in SHAPES.items()}
    assert all(r.valid == (r.reason is None) for r in got)
    assert validity.validity(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_rings_and_crowded_cells(spark, monkeypatch):
    monkeypatch.setattr(spatial, "HOT", 5)
    turn = np.linspace(0, 2 * np.pi, 20_001)[:-1]
    def ring(r, t=turn):
        pts = [(float(a), float(b)) for a, b in zip(r * np.cos(t), r * np.sin(t))]
        return [*pts, pts[0]]
    wave = 1 + 0.3 * np.sin(40 * turn)
    crossed = ring(wave)
    crossed[7000], crossed[7003] = crossed[7003], crossed[7000]
    few = np.linspace(0, 2 * np.pi, 301)[:-1]
    star = ring(np.where(np.arange(300) % 2, 1.0, 0.001), few)
    rows = [("wave", [ring(wave)], "x"), ("crossed", [crossed], "x"), ("star", [star], "x")]
    got = {r["name"]: r.reason for r in validity.validity(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"wave": None, "crossed": "crossing", "star": None}
