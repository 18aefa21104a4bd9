"""Hierarchies against a plain walk in Python."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.operators import hierarchy as hi

SCHEMA = "node_id BIGINT, is_root BOOLEAN, parent_id BIGINT, depth INT, children ARRAY<BIGINT>, loaded_at TIMESTAMP, extra STRING"
T1, T2 = "2021-01-01", "2021-02-01"


def frame(spark, rows):
    import datetime as dt

    day = lambda s: dt.datetime.fromisoformat(s) if s else None
    return spark.createDataFrame([(*r[:5], day(r[5]), "x") for r in rows], SCHEMA)


def walk(parents, roots, depth):
    """{node: (anomaly, top)} of nodes with one."""
    out = {}
    for n in parents:
        seen, at = [n], n
        while parents[at] is not None and parents[at] in parents and parents[at] not in seen:
            at = parents[at]
            seen.append(at)
        nxt = parents[at]
        if nxt in seen:
            loop = seen[seen.index(nxt) :]
            out[n] = ("cycle" if n in loop else "below_cycle", min(loop))
        elif nxt is not None or not roots.get(at):
            out[n] = ("dangling", at)
        elif depth.get(n) != len(seen) - 1:
            out[n] = ("wrong_depth", at)
    return out


def test_empty(spark):
    h = hi.decompose(frame(spark, []))
    assert hi.anomalies(h).count() == 0
    assert hi.numbered(h).count() == 0
    assert hi.paths(h).count() == 0


def test_dirty_rows(spark):
    rows = [
        (1, True, None, 0, [2, 3], T1), (2, False, 1, 1, None, T1), (2, False, 1, 1, None, T1),
        (3, False, None, 1, None, T1),  # named by its parent's children
        (4, False, 99, 1, None, T1),  # parent isn't there
        (5, False, 4, None, None, T1), (6, False, 6, 0, None, T1),  # its own parent
        (7, False, 8, 0, None, T1), (8, False, 7, 0, None, T1), (9, False, 8, 0, None, T1),
        (10, None, None, 0, None, T1), (11, False, 2, 7, None, T1), (11, False, 2, 2, None, T2),  # the later row counts
        (12, False, 2, None, None, None), (None, True, None, 0, [4], T1), (13, False, None, None, None, T1),
    ]
    got = {r.node_id: (r.anomaly, r.top_id) for r in hi.anomalies(hi.decompose(frame(spark, rows))).collect()}
    assert got == {4: ("dangling", 4), 5: ("dangling", 4), 6: ("cycle", 6), 7: ("cycle", 7), 8: ("cycle", 7), 9: ("below_cycle", 7), 10: ("dangling", 10), 12: ("wrong_depth", 1), 13: ("dangling", 13)}


def shape(kind, n, rng):
    if kind == "path":
        return {i: i - 1 if i else None for i in range(n)}
    if kind == "star":
        return {i: 0 if i else None for i in range(n)}
    return {i: rng.choice([None, rng.randrange(n)]) if rng.random() < 0.1 else (rng.randrange(i) if i else None) for i in range(n)}


@pytest.mark.parametrize(("tree_nodes", "batch"), [(200_000, 100_000), (0, 1), (40, 10)])
def test_shapes(spark, monkeypatch, tree_nodes, batch):
    """Trees labelled whole, by rounds of joins, and some one way and some the other."""
    monkeypatch.setattr(hi, "TREE_NODES", tree_nodes)
    monkeypatch.setattr(hi, "BATCH_NODES", batch)
    monkeypatch.setattr(hi, "CHAIN_BLOCK", 4)
    monkeypatch.setattr("seqloom.operators.skew.HOT_ROWS", 5)
    monkeypatch.setattr(hi, "SIBLING_BLOCK", 7)
    rng = random.Random(5)
    for kind, n in (("path", 70), ("star", 60), ("mixed", 90)):
        parents = shape(kind, n, rng)
        roots = {i: p is None for i, p in parents.items()}
        rows = [(i, roots[i], p, None, None, T1) for i, p in parents.items()]
        h = hi.decompose(frame(spark, rows))
        want = walk(parents, roots, {})
        got = {r.node_id: (r.anomaly, r.top_id) for r in hi.anomalies(h).collect()}
        assert got == want, kind
        sound = {n for n, (a, _) in want.items() if "cycle" not in a}
        chain = {}
        for x in sound:
            chain[x] = [x]
            while parents[chain[x][-1]] is not None:
                chain[x].append(parents[chain[x][-1]])
        nodes = {r.node_id: r for r in hi.numbered(h).collect()}
        assert set(nodes) == sound
        for x, r in nodes.items():
            assert (r.depth, r.root_id) == (len(chain[x]) - 1, chain[x][-1])
            below = {y for y in sound if x in chain[y][1:]}
            assert r.n_below == len(below)
            assert {y for y, s in nodes.items() if s.root_id == r.root_id and r.pre < s.pre <= r.last} == below
        assert {r.node_id: r.path for r in hi.paths(h).collect()} == {x: c[::-1] for x, c in chain.items()}
        assert {(r.ancestor_id, r.node_id, r.distance) for r in hi.descendants(h).collect()} == {(a, x, i) for x, c in chain.items() for i, a in enumerate(c) if i}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 14)), min_size=1, max_size=14))
def test_random_links(spark, links):
    parents = dict(enumerate(links))
    rows = [(i, p is None, p, 1, None, T1) for i, p in parents.items()]
    got = {r.node_id: (r.anomaly, r.top_id) for r in hi.anomalies(hi.decompose(frame(spark, rows))).collect()}
    assert got == walk(parents, {i: p is None for i, p in parents.items()}, dict.fromkeys(parents, 1))
