"""Merging of duplicate places against the sequential merge, and likeness of names against the plain recurrence."""

import random
from math import asin, cos, radians, sin, sqrt

import numpy as np
import pytest

from lodestar.operators import dedupe


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diag = 0
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], diag + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_common_lengths_match_the_recurrence():
    r = random.Random(1)
    make = lambda: "".join(r.choices("abc é日🙂", k=r.choice([0, 1, 5, 30, 63, 64, 65, 128, 200])))
    a, b = [make() for _ in range(300)], [make() for _ in range(300)]
    assert dedupe.common_lengths(a, b).tolist() == [common(x, y) for x, y in zip(a, b)]
    assert dedupe.common_lengths([], []).tolist() == []
    assert dedupe.common_lengths(["", "x"], ["", "x"]).tolist() == [0, 1]


def test_common_lengths_in_small_steps(monkeypatch):
    monkeypatch.setattr(dedupe, "_TABLE", 1)
    assert dedupe.common_lengths(["abcd", "xyz", "q" * 70], ["acd", "yx", "q" * 66]).tolist() == [3, 1, 66]


def tokens(name):
    latin = "".join(c if "a" <= c <= "z" or "0" <= c <= "9" else " " for c in (name or "").lower()).split()
    return " ".join(latin), " ".join(sorted(latin))


def metres(a, b):
    la, lo, lb, lp = map(radians, (a["lat"], a["lon"], b["lat"], b["lon"]))
    return 2 * 6371000.0 * asin(sqrt(min(1.0, sin((lb - la) / 2) ** 2 + cos(la) * cos(lb) * sin((lp - lo) / 2) ** 2)))


def in_order(rows):
    """The merge, one record after the other."""
    groups = {}
    for r in sorted(rows, key=lambda r: r["poi_id"]):
        cell = (np.floor(r["lat"] * 100 + 0.5), np.floor(r["lon"] * 100 + 0.5))
        worth = lambda x: (bool(x["hours_parsed"]), bool(x["fee_parsed"]), x["wikidata"] is not None, (x["name"] or "é").isascii())
        x, xs = tokens(r["name"])
        for g in groups.setdefault(cell, []):
            c = g["holder"]
            y, ys = tokens(c["name"])
            like = xs and ys and 200 * common(xs, ys) / (len(xs) + len(ys)) >= 85
            if ((x and y and (x in y or y in x)) or like) and metres(r, c) < 200:
                g["n"] += 1
                if worth(r) > worth(c):
                    g["holder"] = r
                break
        else:
            groups[cell].append({"holder": r, "n": 0})
    return sorted((g["holder"]["poi_id"], g["n"]) for gs in groups.values() for g in gs)


SCHEMA = "poi_id string, name string, lat double, lon double, hours_parsed boolean, fee_parsed boolean, wikidata string"


def places(seed, n, words, spread):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        name = None if r.random() < 0.02 else " ".join(r.choices(words, k=r.choice([1, 2, 2, 3]))) + r.choice(["", "", " ලංකා"])
        row = (f"node/{r.randrange(10**6):06d}-{i}", name, 7.0 + r.random() * spread, 80.0 + r.random() * spread, r.choice([True, False, None]), r.choice([True, False]), r.choice([None, "Q1"]))
        rows.append(dict(zip(SCHEMA.replace(",", "").split()[::2], row)))
    return rows


@pytest.mark.parametrize("seed,n,spread", [(1, 120, 0.004), (2, 200, 0.009), (3, 50, 0.0005)])
def test_rounds_give_the_rows_of_the_merge_in_order(spark, seed, n, spread):
    rows = places(seed, n, ["lake", "lakes", "view", "kandy", "hotel", "sea", "temple"], spread)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = dedupe.dedupe_pois(df)
    assert got.columns == ["poi_id", "name", "lat", "lon", "merged"]
    want = in_order(rows)
    assert 1 < len(want) < n
    assert sorted((r.poi_id, r.merged) for r in got.collect()) == want


def test_a_chain_is_decided_in_order(spark):
    # each is alike to the next only, as the rest are too far: every second one stays
    rows = [(f"n{i:03d}", "bus stop", 7.0 + i * 0.0012, 80.0, False, False, None) for i in range(4)]
    got = dedupe.dedupe_pois(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.poi_id, r.merged) for r in got) == in_order([dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in rows])


def test_nothing_to_merge(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert dedupe.dedupe_pois(none).collect() == []
    one = spark.createDataFrame([("a", None, 7.0, 80.0, None, None, None), ("b", None, 7.0, 80.0, None, None, None)], SCHEMA)
    assert sorted((r.poi_id, r.merged) for r in dedupe.dedupe_pois(one).collect()) == [("a", 0), ("b", 0)]
