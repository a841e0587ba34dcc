"""Vector operators and fill-in-the-middle against plain versions and SQL."""

import hashlib
import re

import duckdb
import numpy as np
import pytest

from lodestar.llm import fill_middle as FM
from lodestar.llm import hard_negatives as HN
from lodestar.llm import pca_dedup as PD
from lodestar.llm import queries as Q
from tests.conftest import DATA

SCHEMA = "vec_id long, label int, embedding array<float>, score double, slot int, cls long, block long"


def table(spark, rows, schema=SCHEMA):
    """Rows with columns of names that the operators use inside."""
    return spark.createDataFrame([(*r, 0.5, 1, 2, 3) for r in rows], schema)


def unit(x):
    return (x / np.linalg.norm(x)).astype(np.float32).tolist()


def broken(n):
    """Rows that take no part, by id from n on."""
    return [(n, None, [1.0, 0.0]), (n + 1, 1, None), (n + 2, 1, [1.0, None]), (n + 3, 1, [float("nan"), 1.0]), (n + 4, 1, [float("inf"), 1.0])]


def brute_negatives(rows, every=50, positives=5, negatives=3):
    seen = {}
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            seen[(i, label, tuple(e))] = [int(np.floor(256.0 * float(np.float32(x)))) for x in e]
    out = []
    for (i, label, _), q in seen.items():
        if i % every:
            continue
        scored = [(-min(2**63 - 1, max(-(2**63), sum(a * b for a, b in zip(q, w)))), j, other == label) for (j, other, _), w in seen.items() if len(w) == len(q)]
        scored.sort()
        for p, pid in [(-s, j) for s, j, same in scored if same and j != i][:positives]:
            hits = [(j, -s) for s, j, same in scored if not same and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(i, pid, r, j, p, s) for r, (j, s) in enumerate(hits, 1)]
    return sorted(out)


def hard_rows():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(400):
        c = centre[rng.integers(4)]
        rows.append((int(i), int(rng.integers(3)), unit(c + rng.normal(size=6) * rng.choice([0.05, 0.4, 1.0]))))
    rows += [(400 + i, i % 2, rows[0][2]) for i in range(30)]  # ties
    rows += [rows[7], rows[7], (450, 0, rows[7][2]), (450, 1, rows[9][2]), (500, 2, [])]  # repeats, one id twice, no components
    rows += [(550, 1, [3.0e37, 1.0]), (551, 1, [2.0e37, -1.0]), (552, 0, [2.0e37, 5.0]), (600, 1, [1.0e5, 2.0e6]), (601, 1, [1.0e5, 2.0e6]), (602, 2, [0.9e5, 1.9e6])]
    return rows + broken(700) + [(None, 1, [1.0, 2.0])]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rows = hard_rows()
    want = brute_negatives(rows)
    assert len(want) > 40
    for block in (1 << 14, 100):
        monkeypatch.setattr(HN, "ROW_BLOCK", block)
        monkeypatch.setattr(HN, "ANCHOR_BLOCK", 3 if block == 100 else block)
        got = [tuple(r) for r in HN.hard_negatives(table(spark, rows).repartition(3)).collect()]
        assert sorted(got) == want


def test_hard_negatives_of_empty_and_single_tables(spark):
    for rows in ([], [(50, 1, [1.0])], broken(50)):
        assert HN.hard_negatives(table(spark, rows)).collect() == []


def test_window_limits_are_exact():
    a = np.array([[3.0, -1.0], [2.0**30, 2.0**30]])
    assert HN.inner(a, a).tolist() == [[10, 2 * 2**30], [2 * 2**30, 2**61]]
    big = np.array([[2.0**40, 1.0]])
    assert HN.inner(big, big).tolist() == [[2**63 - 1]]


def test_shares_round_apart(spark):
    values = [-101, -100, -1, 0, 1, 7, 19, 20, 21, 2**63 - 1, -(2**63)]
    df = spark.createDataFrame([(v,) for v in values], "score long")
    got = df.select("score", HN._share("score", 50, True).alias("a"), HN._share("score", 95, False).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(-(-v * 50 // 100), v * 95 // 100) for v in values]


def brute_links(rows, threshold=0.98):
    ok = [i is not None and label is not None and e is not None and len(e) > 0 and all(x is not None and np.isfinite(x) for x in e) and any(e) for i, label, e in rows]
    v = [np.array(e, dtype=np.float32).astype(float) if o else None for (_, _, e), o in zip(rows, ok)]
    near = [[j for j in range(len(rows)) if j != i and ok[i] and ok[j] and rows[i][1] == rows[j][1] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.linalg.norm(v[i]) / np.linalg.norm(v[j]) >= threshold] for i in range(len(rows))]
    group = list(range(len(rows)))
    for i, js in enumerate(near):
        for j in js:
            a, b = group[i], group[j]
            if a != b:
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {}
    for (i, _, _), g in zip(rows, group):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted(((i, len(near[k]), least.get(group[k]) if i is not None else None, i == least.get(group[k]) or i is None) for k, (i, _, _) in enumerate(rows)), key=str)


def dense_rows():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        base = rng.normal(size=24)
        for _ in range(int(rng.choice([1, 2, 8, 60]))):
            rows.append((len(rows), int(c % 3), unit(base + rng.normal(size=24) * 0.03)))
    # a chain: neighbours link, ends do not
    for k in range(30):
        rows.append((len(rows), 1, [float(np.cos(k * 0.15)), float(np.sin(k * 0.15))]))
    rows += [(len(rows) + i, 2, rows[3][2]) for i in range(5)]
    n = len(rows)
    rows += [rows[5], rows[5], (n + 2, 0, [x * 1000 for x in rows[0][2]]), (n + 3, 0, [0.0] * 24), (n + 4, 0, []), (n + 5, 1, [5.0]), (n + 6, 1, [7.0]), (3, 0, rows[9][2])]
    return rows + broken(n + 10) + [(None, 1, [1.0, 2.0])]


@pytest.mark.parametrize("block", [2048, 16])
def test_links_match_brute_force(spark, block):
    rows = dense_rows()
    got = PD.near_duplicates(table(spark, rows).repartition(4), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_links(rows)


def test_links_of_empty_and_single_tables(spark):
    assert PD.near_duplicates(table(spark, [])).collect() == []
    got = PD.near_duplicates(table(spark, broken(1)[:2])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert [tuple(r) for r in PD.near_duplicates(table(spark, [(4, 1, [2.0, 0.0])])).collect()] == [(4, 0, 4, True)]


def test_bounds_lose_no_pair():
    rng = np.random.default_rng(1)
    for d in (1, 3, 8, 9, 40):
        x = rng.normal(size=(120, d))
        x[60:] = x[:60] + rng.normal(size=(60, d)) * rng.choice([0.01, 0.1, 0.3], size=(60, 1))
        u = x / np.linalg.norm(x, axis=1)[:, None]
        for t in (0.5, 0.98):
            i, j = PD.linked(x, x, *PD.candidates(u, u, t), t)
            assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(u @ u.T >= t))))


def test_leading_coordinates_stop_most_pairs():
    rng = np.random.default_rng(2)
    u = rng.normal(size=(500, 64)) * 0.9 ** np.arange(64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    s = u[:, :8] @ u[:, :8].T
    left = np.sqrt((u[:, 8:] ** 2).sum(1))
    assert (s + np.outer(left, left) >= 0.98).mean() < 0.2


TEXTS = ["", None, "\n", "a", "a\n", "\n\n\n", "one\ntwo\nthree", "one\ntwo\nthree\n", "é\n日本\n🙂 x\n\ny", "a <P> b\nc", "x<S\n>", "no\r\nfeed here\x0b", "<M>", "y" * 5000 + "\n" + "z\n" * 3000, "a\x00\n\x00b"]


def plain_fim(doc, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc, n, "plain", None, None, text
    if h4 % 100 < spm:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_matches_plain_version(spark, monkeypatch):
    rows = [(i * 15 + k, t) for i in range(20) for k, t in enumerate(TEXTS)] + [(None, "a\nb\nc"), (3, "same\n"), (3, "same\n"), (-5, "x\ny")]
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, n int, form string, output string").repartition(3)
    for size in (FM.SLICE, 64):
        monkeypatch.setattr(FM, "SLICE", size)
        got = sorted((tuple(r) for r in FM.fill_in_middle(df).collect()), key=str)
        assert got == sorted((plain_fim(d, t) for d, t in rows), key=str)
    part = sorted((tuple(r) for r in FM.fill_in_middle(df, rate=40, spm=0).collect()), key=str)
    assert part == sorted((plain_fim(d, t, 40, 0) for d, t in rows), key=str)
    back = FM.fill_in_middle(df).select("doc_id", FM.restore(FM.F.col("output"), FM.F.col("form")).alias("t")).collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)
    assert FM.fill_in_middle(df.limit(0)).collect() == []


def test_marks_by_number_and_place():
    rng = np.random.default_rng(3)
    for n in (0, 1, 7, 8, 9, 200):
        raw = rng.choice([10, 11, 0x8A, 0x0B, 0x00, 0x80, 0xC3, 97], size=n).astype(np.uint8)
        w = FM.words_of(raw)
        for marks, hit in ((FM.line_ends(w), raw == 10), (FM.inner_bytes(w), (raw & 0xC0) == 0x80)):
            m = FM.Marks(marks)
            assert m.rank(np.arange(n + 1)).tolist() == [0, *np.cumsum(hit).tolist()]
            assert m.select(np.arange(1, hit.sum() + 1)).tolist() == np.flatnonzero(hit).tolist()


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_pca_dedup", "op13_fill_middle"])
def test_same_rows_as_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = Q.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    want = db.sql(Q.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
