import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import jaccard as J
from lodestar.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min(d, least.get(g, d))
    return sorted((d, len(s), least[g]) for (d, _), s, g in zip(rows, sets, group))


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(60):
        base = rng.choices(words, k=rng.choice([1, 3, 4, 5, 6, 12, 40, 90, 300]))
        for _ in range(rng.choice([1, 1, 2, 4])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, rng.choice([" ", "\n", "\x0b\t"]).join(copy)))
            n += 1
    passage = " ".join(rng.choices(words, k=60))
    rows += [(n + i, " ".join(rng.choices(words, k=20)) + " " + passage) for i in range(30)]
    n += 30
    rows += [(n, ""), (n + 1, None), (n + 2, " \n "), (n + 3, "ONE two"), (n + 4, "one Two"), (n + 5, "É b"), (n + 6, "é b")]
    return rows


def test_components_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, node int, component_id string").repartition(5)
    got = sorted(tuple(r) for r in J.jaccard_components(df).collect())
    assert got == brute(rows)


def test_tiles_of_a_large_component_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(J, "TILE_SHINGLES", 300)
    monkeypatch.setattr(J, "PAIR_SHINGLES", 900)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == brute(rows)


@pytest.mark.parametrize("tile", [100, 2000])
def test_large_groups_are_settled_in_levels(spark, monkeypatch, tile):
    """Near copies, some of which link only to few of the group, and texts close to the group that do not link."""
    monkeypatch.setattr(J, "TILE_SHINGLES", tile)
    monkeypatch.setattr(J, "PAIR_SHINGLES", 3 * tile)
    monkeypatch.setattr(J, "COMMON_SPARE", 4)
    monkeypatch.setattr(J, "SALTS", 3)
    rng = random.Random(2)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            copy[rng.randrange(60)] = f"x{rng.randrange(50)}"
        rows.append((i, " ".join(copy[rng.choice([0, 0, 0, 3, 8]) :] + [f"t{j}" for j in range(rng.choice([0, 0, 5, 12]))])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == brute(rows)


def test_long_text_and_null_ids(spark):
    long = " ".join(f"l{i}" for i in range(200_000))
    rows = [(1, long), (2, long + " more"), (None, "a b c d e f"), (None, "a b c d e f"), (3, "a b c d e f"), (None, None)]
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id or 0), r.n_shingles, (r.component_id or 0)) for r in got) == [(0, 0, 0), (0, 2, 3), (0, 2, 3), (1, 199_996, 1), (2, 199_997, 1), (3, 2, 3)]


def test_bitmaps_bound_the_overlap_at_any_width():
    rng = np.random.default_rng(4)
    for _ in range(300):
        both, a, b = rng.integers(0, 200), rng.integers(1, 200), rng.integers(1, 300)
        h = rng.integers(0, 1 << 63, both + a + b, dtype=np.uint64)
        x, y = np.unique(h[: both + a]), np.unique(np.concatenate([h[:both], h[both + a :]]))
        rows = J.folded([J.bitmap(x), J.bitmap(y)])
        assert J.most_shared(0, np.array([1]), rows, np.array([len(x), len(y)]))[0] >= len(np.intersect1d(x, y))


def test_close_nodes_keep_every_linked_pair_of_two_classes():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    sets = []
    for i in range(60):
        some = base[rng.random(80) < 0.9] if i % 2 else rng.integers(0, 1 << 63, 70, dtype=np.uint64)
        sets.append(np.unique(np.concatenate([some, rng.integers(0, 1 << 63, rng.integers(0, 12), dtype=np.uint64)])))
    classes = np.arange(60) // 3
    close = J.close_nodes(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], classes)
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if classes[i] != classes[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                assert close[i] and close[j]
    assert not close[0::2].all()


def test_empty_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g")], "doc_id long, text string")
    assert sorted(tuple(r) for r in J.jaccard_components(df).collect()) == [(1, 3, 1), (1, 3, 1), (2, 3, 1)]
    assert [r.doc_id for r in J.drop_near_copies(df).collect()] == [1]
    assert J.jaccard_components(df.limit(0)).count() == 0


def test_linked_sets_post_enough_in_common_in_any_order():
    """Both of two linked sets post ``least_shared`` shingles that the other posts too, whatever the order."""
    rng = random.Random(5)
    for _ in range(3000):
        n = rng.choice([1, 2, 5, 20, 48, 63, 64, 66, 88, 120, 200])
        m = rng.randrange(n, 4 * n // 3 + 1)
        both = rng.randrange(-(-3 * (n + m) // 7), n + 1)
        rank = list(range(n + m - both))
        if rng.random() < 0.5:  # what they share comes last, as shingles of common passages do
            rank.sort(key=lambda x: x < both)
        else:
            rng.shuffle(rank)
        at = {x: i for i, x in enumerate(rank)}
        a, b = range(n), [*range(both), *range(n, n + m - both)]
        least = lambda s: set(sorted(s, key=at.get)[: J.postings_of(len(s), 75)])
        shared = len(least(a) & least(b))
        assert shared >= J.least_shared(n, 75) and shared >= J.least_shared(m, 75), (n, m, both)


def test_contained_sets_of_all_sizes_are_linked(spark):
    """Sets of 45 to 105 shingles inside sets 4/3 their size, each pair at a Jaccard of 0.75 or just above."""
    rng = random.Random(11)
    rows = []
    for i in range(300):
        m = 60 + i % 81
        long = [f"c{rng.randrange(10**7)}" for _ in range(m + 4)]
        rows += [(2 * i, " ".join(long)), (2 * i + 1, " ".join(long[: -(-3 * m // 4) + 4]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in J.jaccard_components(df).collect()}
    assert all(c == d - d % 2 for d, c in got.items())


def test_prefix_copies_of_a_larger_text_are_linked(spark):
    rng = random.Random(8)
    rows = []
    for i in range(150):
        n = rng.randrange(60, 121)
        long = [f"p{rng.randrange(10**6)}" for _ in range(n)]
        short = long[: -(-3 * (n - 4) // 4) + 4]
        rows += [(2 * i, " ".join(long)), (2 * i + 1, " ".join(short))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in J.jaccard_components(df).collect())
    assert got == brute(rows) and all(c == d - d % 2 for d, _, c in got)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 102), (7, 7), (200, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.label for r in connected_components(df).collect()}
    assert all(got[i] == 0 for i in range(51)) and got[102] == 100 and got[200] == 200
    assert connected_components(df.limit(0)).count() == 0


def test_a_tile_takes_each_signature_once(monkeypatch):
    """Signatures are laid out by width once a tile, not once a pair, and the links are those of all pairs, at any threshold."""
    r = np.random.default_rng(8)
    base = np.unique(r.integers(0, 1 << 63, 9000, dtype=np.uint64))
    sets = []
    for i in range(160):
        n = int(r.integers(20, 900))
        at = int(r.integers(0, len(base) - n))
        s = base[at : at + n]
        sets += [s, np.unique(np.append(s[: n - n // 9], r.integers(0, 1 << 63, n // 50 + 1, dtype=np.uint64)))]
    laid, folded = [], J.folded
    monkeypatch.setattr(J, "folded", lambda bits: laid.append(len(bits)) or folded(bits))
    for pct in (75, 20):
        del laid[:]
        links = J.tile_links(sets, pct)
        assert sum(laid) <= len(sets)
        both = [[len(np.intersect1d(a, b, assume_unique=True)) for b in sets] for a in sets]
        want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * both[i][j] >= pct * (len(sets[i]) + len(sets[j]) - both[i][j])]
        assert sorted(J._stars(links)) == sorted(J._stars(want)) and len(want) > len(links) > 100
        close = J.close_nodes(np.array([len(s) for s in sets]), [J.bitmap(s) for s in sets], np.arange(len(sets)), pct)
        assert close[sorted({x for p in want for x in p})].all()


def test_postings_of_a_shingle_share_a_bucket_and_many_share_a_row(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + j) % 90}" for j in range(40 + i % 9))) for i in range(200)], "doc_id long, text string").repartition(3)
    common = np.packbits(np.arange(1 << J.SKETCH_BITS) % 6 > 0)
    rows = J._postings(docs, common, 5, 75).collect()
    got, at = set(), {}
    for x in rows:
        keys, nodes, sizes = np.frombuffer(x.key, np.int64), np.frombuffer(x.node, np.int64), np.frombuffer(x.n, np.int32)
        assert len(keys) == len(nodes) == len(sizes) > 0
        got |= set(zip(keys.tolist(), nodes.tolist(), sizes.tolist()))
        for k, v, n in zip(keys.tolist(), nodes.tolist(), sizes.tolist()):
            at.setdefault((k, v % J.SALTS if n < 0 else None), set()).add(x.bucket)
    assert all(len(b) == 1 for b in at.values()) and len(rows) < len(got) / 2
    crowded, want = np.unpackbits(common).astype(bool), set()
    for _, s in J._sets(pa.RecordBatch.from_pydict({"text": [x.text for x in docs.collect()]}), 5):
        late, p = crowded[J._cell(s)], J.postings_of(len(s), 75)
        light = s[~late][:p]
        for keys, n in ((light, len(s)), (s[late][: p - len(light)], -len(s))):
            want |= {(int(k), J._name(s), n) for k in keys.view(np.int64)}
    assert got == want and {n < 0 for _, _, n in got} == {True, False}
    held = pa.RecordBatch.from_pydict({c: [x[c] for x in rows] for c in ("bucket", "key", "node", "n")}, schema=pa.schema([("bucket", pa.int32()), ("key", pa.binary()), ("node", pa.binary()), ("n", pa.binary())]))
    every, met = J._by_key([held.slice(1)], 75), J._by_key([held.slice(1)], 75, alone=False)
    count = np.unique(every[0], return_counts=True)
    many = np.isin(every[0], count[0][count[1] > 1]) | (every[2] < 0)
    assert {*zip(*(x[many].tolist() for x in every[:3]))} <= {*zip(*(x.tolist() for x in met[:3]))} and len(met[0]) <= len(every[0])
