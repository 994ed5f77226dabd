"""Vector codes and nearest neighbours against brute force, and on odd input."""

import hashlib

import numpy as np
import pytest

from gleanframe.llm import code_bounds, prefix_forest

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def table(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def vectors(n, length=32, seed=1, centres=6, spread=0.3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((centres, length))[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, length))
    return x.astype(np.float32)


def coded(rows, parts=8, entries=16, rounds=6):
    """Plain assignment to all entries, in Python's whole numbers; rows (vec_id, vector, label)."""
    kept = [(i, np.floor(4096 * np.array(v, np.float64)).astype(np.int64), g) for i, v, g in rows
            if v is not None and None not in v and np.isfinite(np.array(v, np.float64)).all()]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))[:entries]
    width = len(kept[0][1]) // parts
    x = np.array([v for _, v, _ in kept]).reshape(len(kept), parts, width)
    books = [np.array([v.reshape(parts, width)[p] for _, v, _ in first]) for p in range(parts)]

    def assigned():
        square = [((x[:, p, None, :] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        return [s.argmin(axis=1) for s in square], sum(s.min(axis=1) for s in square)

    for _ in range(rounds):
        for p, own in enumerate(assigned()[0]):
            for k in range(len(first)):
                if (own == k).any():
                    books[p][k] = x[own == k, p].sum(axis=0) // (own == k).sum()
    code, error = assigned()
    by_label = {}
    for (_, _, g), e in zip(kept, error.tolist()):
        by_label[g] = by_label.get(g, 0) + e
    digest = hashlib.sha256(",".join(str(v) for p in range(parts) for entry in books[p].tolist() for v in entry).encode()).hexdigest()
    return sorted((i if i is not None else -1, "".join(f"{c[r]:02x}" for c in code), int(error[r]), by_label[g], digest) for r, (i, _, g) in enumerate(kept))


def got_codes(df):
    return sorted((r.vec_id if r.vec_id is not None else -1, r.code, r.error, r.label_error, r.codebooks_sha256) for r in code_bounds.code_vectors(df).rows.collect())


@pytest.mark.parametrize("n, spread", [(7, 0.3), (40, 0.0), (900, 0.3), (900, 2.0)])
def test_codes(spark, n, spread):
    rows = [(i * 3, v.tolist(), None if i % 5 == 0 else i % 4) for i, v in enumerate(vectors(n, spread=spread))]
    assert got_codes(table(spark, rows)) == coded(rows)


def test_codes_of_ties_repeats_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    grid = [(i, (rng.integers(-2, 3, 16) / 4096).tolist(), i % 3) for i in range(300)]           # many equal distances
    odd = [(400, None, 1), (401, [None] * 16, 1), (402, [float("nan")] * 16, 1), (403, [float("inf")] + [0.0] * 15, 2), (None, [0.5] * 16, None)]
    rows = grid + grid[:50] + odd
    wrong = [(404, [1.0] * 8, 1), (405, [], 1)]
    names = "n, rows, x, state, tally, i, code, error, v, codes"
    df = table(spark, rows + wrong).selectExpr("*", *[f"1 AS {c}" for c in names.split(", ")])
    assert got_codes(df) == coded(rows)


def test_no_codes(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")] * 8, 1), (3, [1.0] * 9, 1)]):
        df = code_bounds.code_vectors(table(spark, rows)).rows
        assert df.collect() == [] and df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_bounds_hold_and_save_work():
    """After every move of the entries: no bound is above its distance, and most rows need few entries."""
    rng = np.random.default_rng(9)
    x = np.floor(4096 * vectors(2000, 4, 5, 12, 0.05).astype(np.float64)).astype(np.int64)
    book, moved = x[:16].copy(), np.zeros(16, np.int64)
    state = np.zeros(len(x), code_bounds.PARTS_STATE)
    state["upper"], state["lower"] = code_bounds.FAR, -code_bounds.FAR
    for turn, bounds in enumerate([4, 4, 6, 3, 1, 2, 2]):
        need = code_bounds.assign(x, book, moved, state, bounds)
        square = ((x[:, None, :] - book) ** 2).sum(axis=2)
        assert (state["code"] == square.argmin(axis=1)).all()
        assert (state["upper"].astype(np.int64) ** 2 >= square.min(axis=1)).all()
        for r in range(0, len(x), 7):
            held = state["near"][r, :state["held"][r]]
            rest = set(range(16)) - {int(state["code"][r]), *held.tolist()}
            assert len(set(held.tolist())) == len(held) <= bounds
            assert all(max(0, int(low)) ** 2 <= square[r, k] for low, k in zip(state["lower"][r], held))
            assert all(max(0, int(state["outer"][r])) ** 2 <= square[r, k] for k in rest)
        assert turn == 0 or (need == 0).mean() > 0.5
        after = book + rng.integers(-20, 21, book.shape)
        moved, book = code_bounds.root_above(((after - book) ** 2).sum(axis=1)), after


def test_bounds_adapt():
    grown = code_bounds.next_bounds(np.array([10, 0, 0, 0, 0, 0, 0, 90]), 3)
    assert grown == 4 and code_bounds.next_bounds(np.array([1000, 5, 1, 0, 0, 0, 0, 0]), 4) == 1
    assert code_bounds.next_bounds(np.array([500, 100, 100, 100, 100, 0, 0, 10]), 4) == 4


# --- nearest neighbours

def found(df, **options):
    out = {}
    for r in prefix_forest.nearest(df, **options).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


def exact(rows, every=20, k=20):
    ids = np.array([i for i, *_ in rows])
    x = np.array([v for _, v, *_ in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [(n + 1, int(ids[i]), score[i]) for n, i in enumerate(order)]
    return out


@pytest.mark.parametrize("spread, unit", [(0.3, True), (0.3, False), (3.0, True)])
def test_recall(spark, spread, unit):
    x = vectors(3000, 48, 8, 10, spread)
    if unit:
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got, want = found(table(spark, rows), rule=prefix_forest.Forest(block=700)), exact(rows)
    assert got.keys() == want.keys()
    hits = sum(len({v for _, v, _ in got[q]} & {v for _, v, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert hits >= 0.9
    score = {(q, v): s for q, found_ in got.items() for _, v, s in found_}
    assert all(s == pytest.approx(float(x[q].astype(np.float64) @ x[v].astype(np.float64)), abs=1e-12) for (q, v), s in score.items())
    assert all([r for r, _, _ in f] == list(range(1, 21)) and f == sorted(f, key=lambda t: (-t[2], t[1])) for f in got.values())


def test_few_vectors_copies_and_odd_rows(spark):
    x = vectors(15, 8, 4)
    rows = [(i * 10, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist(), 0) for i in range(5)]
    odd = [(20000, None, 0), (20020, [0.0] * 8, 0), (20040, [float("nan")] * 8, 0), (20060, [None] * 8, 0), (None, x[1].tolist(), 0), (20080, [1.0], 0), (20100, [], 0)]
    df = table(spark, rows + odd).selectExpr("*", *[f"1 AS {c}" for c in ("row", "block", "v", "kth", "asks", "rank", "score", "query_id")])
    assert found(df) == exact(rows)
    again = table(spark, rows + rows[:3])                                       # rows 0 and 20 twice: each finds its copy
    assert {v for _, v, _ in found(again)[0]} >= {0}


def test_no_neighbours(spark):
    for rows in ([], [(1, None, 0), (20, [0.0, 0.0], 0)], [(20, [1.0, 2.0], 0)]):
        df = prefix_forest.nearest(table(spark, rows))
        assert df.collect() == [] and df.columns == ["query_id", "rank", "vec_id", "score"]


def test_prefix_ranges_hold_what_shares_the_prefix():
    x = vectors(400, 16, 2).astype(np.float64)
    rule = prefix_forest.Forest(trees=5)
    planes = prefix_forest.directions(rule, 16)
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    block = prefix_forest.Block(np.arange(400), np.arange(400), x, planes, longest)
    strings, q = prefix_forest.hash_strings(x, planes, longest), prefix_forest.query_strings(x[:9], planes)
    for depth in (0, 1, 5, 32):
        start, stop = block.ranges(q, np.full(9, depth))
        for t in range(5):
            for i in range(9):
                same = np.flatnonzero(strings[:, t] >> np.uint64(32 - depth) == q[i, t] >> np.uint64(32 - depth))
                assert set(block.order[t][start[t, i]:stop[t, i]].tolist()) == set(same.tolist())
    depth = block.descend(q, 30)
    start, stop = block.ranges(q, depth)
    assert ((stop - start).sum(axis=0) >= 30).all()
    start, stop = block.ranges(q, depth + 1)
    assert ((stop - start).sum(axis=0) < 30).all()
