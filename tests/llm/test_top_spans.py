"""Top N and shared spans against brute force."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import spans, topn



def test_top(spark):
    order = [F.asc("evalue"), F.desc("bits"), F.asc("item")]
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None, ""]), i, rng.choice([0.0, 0.5, 1.0]), float(rng.randrange(3))) for i in range(400)]
    rows += rng.choices(rows, k=200)  # repeated rows count once
    df = spark.createDataFrame([(*r, 7) for r in rows], "g STRING, item BIGINT, evalue DOUBLE, bits DOUBLE, rank INT")
    for n in (1, 5, 1000):
        got = {(r.g, r.item, r["rank"]) for r in topn.top_n(df.drop("rank"), "g", order, "item", n, salts=4).collect()}
        want = set()
        for g in {r[0] for r in rows}:
            items = sorted({r[1:] for r in rows if r[0] == g}, key=lambda x: (x[1], -x[2], x[0]))
            want |= {(g, x[0], i + 1) for i, x in enumerate(items[:n])}
        assert got == want
    assert topn.top_n(df.limit(0), "g", order, "item", 5).count() == 0


def brute(records, least):
    """{id: runs of positions in a run that another record has too}."""
    owners = {}
    for s, t in records.items():
        for i in range(len(t) - least + 1):
            owners.setdefault(t[i : i + least], set()).add(s)
    out = set()
    for s, t in records.items():
        at = {p for i in range(len(t) - least + 1) if owners[t[i : i + least]] != {s} for p in range(i + 1, i + least + 1)}
        runs = []
        for p in sorted(at):
            if runs and runs[-1][1] == p - 1:
                runs[-1][1] = p
            else:
                runs.append([p, p])
        out |= {(s, a, b) for a, b in runs}
    return out


def family(rng, n):
    base = ["".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.choice([5, 60, 150]))) for _ in range(5)]
    base.append("A" * 90)
    base.append("QP" * 60)
    out = {}
    for i in range(n):
        t = "".join(rng.choice(base)[rng.randrange(40) :] for _ in range(rng.choice([1, 2, 3])))
        t = list(t)
        for _ in range(rng.randrange(4)):
            if t:
                t[rng.randrange(len(t))] = rng.choice("ACDW")
        out[i] = "".join(t) or "A"
    return out


@pytest.mark.parametrize("shard", [2000, 2, 1])
def test_spans(spark, shard, monkeypatch):
    monkeypatch.setattr("seqloom.operators.skew.HOT_ROWS", 10)
    rng = random.Random(shard)
    recs = family(rng, 40)
    recs |= {100: recs[0], 101: recs[0], 102: "", 103: "ACD" * 13, 104: "W" * 300, 105: "W" * 39, 106: "".join(rng.choice("ACDEFGHIKL") for _ in range(3000))}
    rows = [(s, t.lower() if s % 3 else " ".join(t) + "*\n", "x") for s, t in recs.items()]
    rows += rows[:10] + [(None, "A" * 50, "x"), (200, None, "x")]
    df = spark.createDataFrame(rows, "seq_id BIGINT, residues STRING, owner STRING")
    got = [(r.seq_id, r.span_from, r.span_to) for r in spans.shared_spans(df, shard=shard).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(recs, 40)
    assert spans.shared_spans(df.limit(0)).count() == 0
    amount = {r.seq_id: (r.n_residues, r.n_shared) for r in spans.shared_amount(df, spans.shared_spans(df)).collect()}
    n = len(recs[0])
    assert amount[100] == (n, n if n >= 40 else 0) and amount[200] == (0, 0)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=4))
def test_matching_statistics(texts):
    auto = spans.Automaton(texts, [(i, i) for i in range(len(texts))])
    for i, t in enumerate(texts):
        others = [x for j, x in enumerate(texts) if j != i]
        for k, m in enumerate(auto.matching(t, i)):
            best = max((n for n in range(k + 2) if any(t[k + 1 - n : k + 1] in x for x in others)), default=0)
            assert m == best


def test_short_span_is_refused(spark):
    with pytest.raises(ValueError):
        spans.shared_spans(spark.createDataFrame([(1, "A")], "seq_id BIGINT, residues STRING"), 10)
