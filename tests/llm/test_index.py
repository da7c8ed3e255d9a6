"""The inverted multi-index: the query itself against brute force, and the work that a group does."""

from __future__ import annotations

import numpy as np

from marklane.llm import ann
from marklane.llm.entry import QUERIES

SF = "/root/testdata/sf0.01"


def test_query_op1_against_brute_force(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    got: dict = {}
    for r in QUERIES["op1_inverted_multi_index"](spark, SF).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [i for i in ids.tolist() if i % 20 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        own = int(np.flatnonzero(ids == q)[0])
        s = x @ x[own]
        found = sorted(got[q])
        assert [r for r, *_ in found] == list(range(1, min(20, len(ids) - 1) + 1)) and q not in {v for _, v, _ in found}
        assert [(-score, v) for _, v, score in found] == sorted((-score, v) for _, v, score in found)
        assert all(abs(score - s[np.flatnonzero(ids == v)[0]]) < 1e-9 * (1 + abs(score)) for _, v, score in found)
        s[own] = -np.inf
        hits += len({v for _, v, _ in found} & set(ids[np.argsort(-s, kind="stable")[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(asked)


def test_group_multiplies_only_visited_cells(monkeypatch):
    """Scores of entries in cells that no query visits are never formed: they may hold anything."""
    rng = np.random.default_rng(4)
    group = ann._Group(8, 3, 0)
    x = rng.normal(size=(60, 8))
    for i, v in enumerate(x):
        group.add(i, (v if i % 6 else v * np.nan).tobytes(), i % 6)
    y = rng.normal(size=(5, 8))
    cells = [np.array(c) for c in ([1, 2], [3], [5, 1, 4], [], [2, 99])]
    found = {}
    for q, e, s in group.nearest(np.array([100, 101, 102, 103, 1]), y, cells):
        found[int(q[0])] = (e.tolist(), s.tolist())
    assert 103 not in found
    for i, q in enumerate([100, 101, 102, 103, 1]):
        inside = [j for j in range(60) if j % 6 in cells[i] and j != q]
        want = sorted(inside, key=lambda j: (-float(x[j] @ y[i]), j))[:3]
        assert found.get(q, ([], []))[0] == want


def test_group_that_is_mostly_visited_gives_the_same():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(90, 8)), rng.normal(size=(4, 8))
    group = ann._Group(8, 5, 0)
    for i, v in enumerate(x):
        group.add(i, v.tobytes(), i % 3)
    cells = [np.array(c) for c in ([0, 1, 2], [0, 1], [2, 1, 0], [1])]
    got = {int(q[0]): e.tolist() for q, e, _ in group.nearest(np.array([0, 101, 102, 103]), y, cells)}
    for i, q in enumerate([0, 101, 102, 103]):
        inside = [j for j in range(90) if j % 3 in cells[i] and j != q]
        assert got[q] == sorted(inside, key=lambda j: (-float((x[j] * y[i]).sum()), j))[:5]


def test_places_hold_every_entry_once():
    rng = np.random.default_rng(5)
    index = ann.Index(rng.normal(size=(7, 4)), rng.normal(size=(5, 5)), 1.0, 4)
    index.counts = rng.integers(0, 9, (7, 5))
    start, counts = index.places(), index.counts.reshape(-1)
    taken = sorted(p for s, n in zip(start.tolist(), counts.tolist(), strict=True) for p in range(s, s + n))
    assert taken == list(range(int(counts.sum())))
