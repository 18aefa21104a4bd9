"""Column functions, edit scripts and kernels."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.functions import align, edits, minimizers, residue, text
from seqloom.operators import search


def one(spark, value, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{c} {'INT' if isinstance(v, int) else 'STRING'}" for c, v in cols.items()))
    return df.select(value.alias("v")).first().v


@pytest.mark.parametrize(("kmer", "number"), [("ABCD", 578), ("AAAA", 0), ("ZZZZ", 23**4 - 1), ("AJAA", None), ("", None), (None, None)])
def test_hash(spark, kmer, number):
    assert one(spark, residue.kmer_hash("k"), k=kmer) == number
    if number is not None:
        assert one(spark, residue.unhash_kmer("n", 4), n=number) == kmer


@pytest.mark.parametrize(("seq", "skip"), [("ABCDDDDDDDDDDDDDDDDDDXYZ", 21), ("DDDDDDABCDEF", 6), ("DDDDDDABCDEFFFFFFFFFFXYZXYZ", 6), ("ABCDEFFFFFFFFFFFFFFFXYZXYZ", 20), ("ABC", 0), ("", 0), ("AAAAA", 5)])
def test_low_complexity(spark, seq, skip):
    assert one(spark, residue.low_complexity_skip("s", 10, 5), s=seq) == skip


def test_text_functions(spark):
    assert one(spark, text.clean_residues("s"), s="aC*d ß1\n") == "ACD"
    assert one(spark, text.clean_residues("s"), s=None) == ""
    assert one(spark, text.first_word("s"), s=" \tQ1 x") == "Q1"
    assert one(spark, residue.accession("s"), s="sp|ACC|NAME x:2-9") == "ACC"
    assert one(spark, residue.accession("s"), s="tr||NAME") == "tr||NAME"
    assert one(spark, residue.accession("s"), s="PLAIN:3-9") == "PLAIN"
    assert one(spark, residue.gene_family("s"), s="x GN=abc y") == "abc"
    assert one(spark, residue.gene_family("s"), s="x") is None
    assert one(spark, residue.wrap("s", 3), s="ABCDEFG") == "ABC\nDEF\nG\n"
    assert one(spark, residue.wrap("s", 3), s="") == ""
    assert one(spark, residue.drop_stops("s"), s="ab*c") == "ABC"
    assert one(spark, residue.mask("s"), s="AJOU") == "AXXX"
    assert one(spark, residue.reduce_alphabet("s"), s="LCAGSPFEKHX") == "1234567890X"
    assert one(spark, residue.ungapped_length("s"), s="A--B") == 2
    assert [one(spark, residue.repetitive("s"), s=x) for x in ("AAA", "AAB", "A", "")] == [True, False, False, False]
    assert one(spark, residue.identity_pct("a", "b"), a="ABCD", b="ABXX") == 50
    assert one(spark, residue.identity_pct("a", "b"), a="", b="") == 0
    assert one(spark, residue.identity_pct("a", "b"), a="A", b="AB") is None
    assert one(spark, residue.identity_frac("a", "b"), a="A-C", b="AAC") == pytest.approx(2 / 3)
    assert one(spark, residue.best_diagonal("a", "b", 2), a="XABCD", b="ABCDE") == 1.0
    assert [(x.pos, x.kmer) for x in one(spark, residue.kmers("s", 2), s="ABC")] == [(0, "AB"), (1, "BC")]
    assert one(spark, residue.kmers("s", 2, last=False), s="AB") == []
    assert one(spark, residue.runs("s", 3), s="AAABCCCC") == ["AAA", "CCCC"]


def aligned(rng, n):
    cols = [rng.choice([("A", "A"), ("C", "C"), ("A", "D"), ("-", "E"), ("F", "-")]) for _ in range(n)]
    return "".join(a for a, _ in cols), "".join(b for _, b in cols)


def test_edit_scripts(spark):
    rng = random.Random(1)
    rows = [aligned(rng, rng.randrange(0, 30)) for _ in range(80)] + [("", ""), ("A", "A"), ("---", "ABC"), ("ABC", "---")]
    df = spark.createDataFrame([(i, *r, r[0].replace("-", ""), r[1].replace("-", "")) for i, r in enumerate(rows)], "id INT, a STRING, b STRING, old STRING, new STRING")
    script = edits.build("a", "b")
    got = df.select("*", edits.to_text(script).alias("t"), edits.apply(script, "old").alias("direct"), edits.apply(edits.parse(edits.to_text(script)), "old").alias("parsed"), edits.apply_forest(edits.forest_ops("a", "b"), "old").alias("forest"), script.alias("s"))
    for r in got.collect():
        assert r.direct == r.parsed == r.forest == r.new
        assert all(p.kind != q.kind or q.start > p.end or p.kind == "i" for p, q in zip(r.s, r.s[1:]))
    assert one(spark, edits.to_text(edits.build("a", "b")), a="AB--CD", b="AXYZC-") == "s1Xi1YZd1-"
    assert one(spark, edits.parse("t"), t="s1") is None
    assert one(spark, edits.parse("t"), t="x1A") is None
    assert one(spark, edits.parse("t"), t="") == []


def test_forest_operations(spark):
    df = spark.createDataFrame([([("SUBSTITUTE", 0, "X"), ("INSERT", 0, "A"), ("DELETE", 0, None), ("INSERT", 3, "Z"), ("DELETE", 9, None)], "abc"), (None, "abc"), ([], "")], "ops ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>, old STRING")
    assert [r.v for r in df.select(edits.apply_forest("ops", "old").alias("v")).collect()] == ["AXbcZ", "abc", ""]
    assert [r.v for r in df.select(edits.disruption("ops", F.lit(1), F.lit(1), F.lit(4)).alias("v")).collect()] == [4, 0, 0]


def naive(a, b, m, gap):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = max(t[i - 1][j - 1] + m[ord(a[i - 1]), ord(b[j - 1])], t[i - 1][j] + gap, t[i][j - 1] + gap)
    return t


@settings(max_examples=150, deadline=None)
@given(st.text("ACDK", max_size=15), st.text("ACDK", max_size=15))
def test_global_alignment(a, b):
    m = search.rule_matrix()
    p, q = align.global_align(a, b, m, banded=False)
    assert p.replace("-", "") == a and q.replace("-", "") == b and len(p) == len(q)
    assert (align.global_table(align.bytes_of(a), align.bytes_of(b), m, -4, False) == np.array(naive(a, b, m, -4)).reshape(len(a) + 1, len(b) + 1)).all()


def test_long_texts_are_aligned_in_pieces():
    rng = random.Random(1)
    a, b = ("".join(rng.choice("ACDE") for _ in range(n)) for n in (950, 130))
    for x, y in ((a, b), (b, a), (a, ""), ("", "")):
        p, q = align.align_whole(x, y, search.rule_matrix(), block=100)
        assert p.replace("-", "") == x and q.replace("-", "") == y and len(p) == len(q)


def test_long_texts_are_aligned_whole():
    """As one table gives it, also after an early insertion that would shift every cut."""
    rng, m = random.Random(2), search.rule_matrix()
    a = "".join(rng.choice("ACDEFGHIKL") for _ in range(900))
    b = a[:20] + "".join(rng.choice("MNPQ") for _ in range(150)) + a[20:]
    noisy = "".join(rng.choice("ACD") if rng.random() < 0.1 else ch for ch in a)
    for x, y in ((a, b), (b, a), (a, noisy), (a, a[:7]), (a, ""), ("", a)):
        for banded in (True, False):
            assert align.align_whole(x, y, m, banded=banded, block=100) == align.global_align(x, y, m, banded=banded)


def test_kernels():
    m = search.rule_matrix()
    assert align.global_align("GHIKLMNPQRSTVW", "GAAAHIKLMNPQRSTVW", m) == ("---GHIKLMNPQRSTVW", "GAAAHIKLMNPQRSTVW")
    assert align.ungapped_growth(*map(align.bytes_of, ("ABCDEFXH", "ABCDEFYZ")), 10, 3, 50) == 6
    assert align.gapped_growth("ABCDEFGHIKLM", "ABCDEFGHIKLM", m) == (12, 12, [(0, 0, 12)])
    assert align.gapped_growth("ACDEFGHIKLWWWWMNPQRSTVY" * 3, "ACDEFGHIKLMNPQRSTVYACDEFGHIKLMNPQRSTVY", m)[2][:2] == [(0, 0, 10), (14, 10, 19)]
    assert align.xdrop("AACDEFKK", 2, "GGCDEFHH", 2, 3, m) == (2, 6, 2, 6)


def test_minimizers_follow_the_text():
    rng = random.Random(2)
    core = "".join(rng.choice("ACDEFGHIKL") for _ in range(40))
    seen = []
    for _ in range(20):
        t = "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(50))) + core + "".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randrange(50)))
        at = t.index(core)
        pos, h = minimizers.minimizers(t.encode(), 20, 40)
        seen.append({x for p, x in zip(pos.tolist(), h.tolist()) if at <= p <= at + 20})
    assert set.intersection(*seen)
    assert len(minimizers.minimizers(b"A" * 39, 20, 40)[0]) == 0


@settings(max_examples=300, deadline=None)
@given(st.text("AB", max_size=40), st.text("AB", max_size=40), st.integers(1, 12), st.integers(1, 5), st.integers(0, 100))
def test_ungapped_growth_by_hand(a, b, window, k, identity):
    """The best next run of k among all that are near, looked for place by place."""
    n, taken = min(len(a), len(b)), 0
    while True:
        for end in range(taken + k, min(n, taken + window) + 1):
            between = [a[i] == b[i] for i in range(taken, end - k)]
            if a[end - k : end] == b[end - k : end] and (not between or 100 * sum(between) // len(between) >= identity):
                taken = end
                break
        else:
            break
    for look in (4_096, window + k + 1):
        align._LOOK = look
        try:
            assert align.ungapped_growth(align.bytes_of(a), align.bytes_of(b), window, k, identity) == taken
        finally:
            align._LOOK = 4_096


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ABC", max_size=30), max_size=6), st.integers(1, 5), st.integers(0, 6))
def test_batch_minimizers(texts, k, more):
    span, chunk = k + more, minimizers._CHUNK
    for size in (chunk, 20):
        minimizers._CHUNK = size
        try:
            got = set(zip(*map(np.ndarray.tolist, minimizers.batch_minimizers([t.encode() for t in texts], k, span))))
        finally:
            minimizers._CHUNK = chunk
        want = set()
        for i, t in enumerate(texts):
            h = [int(minimizers._hashes(np.frombuffer(t[j : j + k].encode(), np.uint8), k)[0].astype(np.int64)) for j in range(len(t) - k + 1)]
            for j in range(len(t) - span + 1):
                p = min(range(j, j + span - k + 1), key=lambda x: (h[x] % 2**64, x))
                want.add((i, p, h[p]))
        assert got == want
