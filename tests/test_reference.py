"""Compression, search, evaluation, sources and streams on small inputs."""

import random
import time
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from seqloom.operators import compress, evaluate, forest, search, seeds
from seqloom.plans import reference
from seqloom.sources import fasta
from seqloom.sources.database import ForestDatabase, SequenceDatabase
from seqloom.streaming import jobs

LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def related(rng, families=4, members=5, n=160):
    out, i = {}, 0
    for _ in range(families):
        base = "".join(rng.choice(LETTERS) for _ in range(n))
        for _ in range(members):
            t = list(base[rng.randrange(20) :])
            for _ in range(rng.randrange(8)):
                t[rng.randrange(len(t))] = rng.choice(LETTERS)
            cut = rng.randrange(len(t))
            out[i] = "".join(t[:cut] + [rng.choice(LETTERS)] * rng.randrange(3) + t[cut:])
            i += 1
    return out | {100: out[0], 101: "", 102: "ACD", 103: "A" * 300, 104: out[0][20:80], 105: "ACD" * 40}


@pytest.fixture(scope="module")
def records():
    return related(random.Random(7))


def frame(spark, recs):
    return spark.createDataFrame(list(recs.items()), "seq_id BIGINT, residues STRING")


def test_flat(spark, records):
    coarse, segments = compress.compress_flat(frame(spark, records))
    back = {r.seq_id: r.residues for r in compress.decompress(coarse, segments).collect()}
    assert back == {i: t for i, t in records.items() if t}
    assert compress.ratio(coarse, frame(spark, records)).first().percent < 60
    assert segments.filter("size(diff) > 0").count() > 0
    coarse, segments = compress.compress_flat(frame(spark, {0: ""}))
    assert coarse.count() == segments.count() == 0


def test_forest(spark, records):
    nodes = compress.compress_forest(frame(spark, records))
    assert {r.seq_id: r.residues for r in compress.restore_forest(nodes).collect()} == {i: t for i, t in records.items() if t}
    assert nodes.agg({"depth": "max"}).first()[0] <= 5 and nodes.filter("depth > 0").count() > 5
    assert compress.compress_forest(frame(spark, {0: ""})).count() == 0


def test_database(spark, records, tmp_path):
    path = str(tmp_path / "db")
    first = {i: t for i, t in records.items() if i % 2 == 0}
    SequenceDatabase.create(frame(spark, first), path)
    db = SequenceDatabase.open(spark, path)
    small = db.coarse.count()
    db.append(frame(spark, records))
    assert {r.seq_id: r.residues for r in db.sequences().collect()} == {i: t for i, t in records.items() if t}
    assert db.coarse.count() > small and compress.ratio(db.coarse, frame(spark, records)).first().percent < 70
    assert db.residues() == sum(map(len, records.values()))
    assert {r.seq_id: r.residues for r in db.get(frame(spark, {1: "", 7: "", 999: ""})).collect()} == {i: records[i] for i in (1, 7)}
    assert db.links(db.coarse.limit(1)).count() >= 1
    with pytest.raises(Exception, match="(?i)exists"):
        SequenceDatabase.create(frame(spark, first), path)
    ro = SequenceDatabase.create(frame(spark, {1: "ACDEF"}), path, read_only=True, overwrite=True)
    with pytest.raises(PermissionError):
        ro.append(frame(spark, {2: "A"}))


def test_search_recall(spark, records):
    recs = {i: t for i, t in records.items() if i < 100}
    df = frame(spark, recs)
    hits = search.search(df.filter("seq_id % 5 = 0"), df).collect()
    found = {(r.query_id, r.subject_id) for r in hits}
    want = {(q, s) for q in recs if q % 5 == 0 for s in recs if q // 5 == s // 5}
    assert len(found & want) >= 0.95 * len(want) and found <= want
    for r in hits:
        assert 1 <= r.qstart <= r.qend <= len(recs[r.query_id]) and 1 <= r.sstart <= r.send <= len(recs[r.subject_id])
        if r.query_id == r.subject_id:
            assert (r.qstart, r.qend) == (1, len(recs[r.query_id]))
    assert search.search(df.limit(0), df).count() == 0
    again = {(r.query_id, r.subject_id) for r in search.search_iterated(df.filter("seq_id % 5 = 0"), df, 2).collect()}
    assert found <= again <= want
    assert search.search_iterated(df.limit(0), df, 2).count() == 0


def local_score(a, b, p):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    e = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    f = [[-(10**9)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = max(e[i - 1][j] - p.gap_extend, h[i - 1][j] - p.gap_open - p.gap_extend)
            f[i][j] = max(f[i][j - 1] - p.gap_extend, h[i][j - 1] - p.gap_open - p.gap_extend)
            h[i][j] = max(0, h[i - 1][j - 1] + int(p.matrix[ord(a[i - 1]), ord(b[j - 1])]), e[i][j], f[i][j])
            best = max(best, h[i][j])
    return best


def test_alignment_scores():
    rng, p = random.Random(3), search.SearchParams(gap_open=4)
    pairs = [("".join(rng.choice("ACDE") for _ in range(rng.randrange(1, 40))), "".join(rng.choice("ACDE") for _ in range(rng.randrange(1, 40)))) for _ in range(40)]
    got = search.align_batch([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], [0] * len(pairs), p)
    assert [s for s, _, _ in got] == [local_score(a, b, p) for a, b in pairs]


def test_alignment_cost_and_kinds():
    """Cells of the band outside the subjects cost nothing; large scores and score tables."""
    rng, p = random.Random(4), search.SearchParams()
    text = lambda n: "".join(rng.choice(LETTERS) for _ in range(n)).encode()
    q, took = [text(120) for _ in range(256)], {}
    for n in (16, 400):
        s = [text(n) for _ in q]
        for _ in range(3):
            began = time.process_time()
            search.align_batch(q, s, [0] * len(q), p)
            took[n] = min(took.get(n, 9e9), time.process_time() - began)
    assert took[16] < 0.6 * took[400]
    s = [a[30:90] + text(5) for a in q]
    got = search.align_batch(q, s, [-32] * len(q), p)
    large = search.align_batch(q, s, [-32] * len(q), replace(p, matrix=p.matrix * 1000, gap_open=11_000, gap_extend=1000))
    assert large == [(1000 * x, y, z) for x, y, z in got] and large[0][0] > 2**16
    assert search.align_batch(q, s, [-32] * len(q), p, [p.matrix[list(a)] if i % 2 else None for i, a in enumerate(q)]) == got


def test_rounds_make_only_what_is_read(spark, monkeypatch):
    """Texts are made once for all rounds, and score tables for the rounds that follow only."""
    saved, save = [], search.Stage.save
    monkeypatch.setattr(search.Stage, "save", lambda self, df, table: saved.append(table) or save(self, df, table))
    rng = random.Random(5)
    text = ["".join(rng.choice(LETTERS) for _ in range(120)) for _ in range(2)]
    df = frame(spark, {1: text[0], 2: text[0][:60] + text[1][60:], 3: text[1]})
    for rounds in (1, 2):
        saved.clear()
        got = {(r.query_id, r.subject_id): r.round for r in search.search_iterated(df.filter("seq_id = 1"), df, rounds).collect()}
        assert got == {(1, 1): 1, (1, 2): 1}
        assert {"subjects", "texts"} <= set(saved) and ("queries1" in saved) == (rounds > 1)


def test_lambda_and_matrix(tmp_path):
    m = search.rule_matrix()
    lam = search.karlin_lambda(m, dict.fromkeys(LETTERS, 1.0))
    assert 0.05 < lam < 1
    (tmp_path / "m.txt").write_text("# c\n   A  B\nA  4 -2\nB -2  5\n")
    got = search.load_matrix(str(tmp_path / "m.txt"))
    assert (got[65, 65], got[65, 66], got[66, 66], got[70, 70]) == (4, -2, 5, -4)


def test_expand_and_dedupe(spark):
    hits = spark.createDataFrame([("q", "c", 5, 9), ("q", "c", 6, 7), ("r", "d", 1, 2)], "query_id STRING, coarse_id STRING, s_from INT, s_to INT")
    seg = spark.createDataFrame([(1, "c", 0, 5), (2, "c", 10, 20), (3, "c", 9, 9), (4, "d", 3, 4)], "seq_id INT, coarse_id STRING, c_start INT, c_end INT")
    assert {tuple(r) for r in search.expand(hits, seg).collect()} == {("q", 1), ("q", 3)}
    wide = search.widest(spark.createDataFrame([(1, 0, 5), (1, 2, 9), (1, 1, 8), (2, 3, 3)], "node_id INT, from0 INT, to0 INT"))
    assert {tuple(r) for r in wide.collect()} == {(1, 1, 8), (2, 3, 3)}
    nodes = spark.createDataFrame([(3, "AB"), (1, "AB"), (2, "C"), (4, ""), (5, None)], "node_id INT, sequence STRING")
    assert {tuple(r) for r in search.representatives(nodes).collect()} == {(3, 1), (1, 1), (2, 2)}


def test_forest_paths(spark):
    import datetime as dt

    row = lambda i, root, p, seq, a, b, diff: (i, root, p, None, [], dt.datetime(2021, 1, 1), seq, a, b, diff)
    rows = [row(1, True, None, "ABCDEFGH", None, None, None), row(2, False, 1, None, 2, 7, [("SUBSTITUTE", 1, "x")]), row(3, False, 2, None, 1, 4, [("DELETE", 0, None), ("INSERT", 3, "y")])]
    tree = spark.createDataFrame(rows, "node_id BIGINT, is_root BOOLEAN, parent_id BIGINT, depth INT, children ARRAY<BIGINT>, loaded_at TIMESTAMP, sequence STRING, parent_start INT, parent_end INT, diff ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>")
    assert {r.node_id: r.sequence for r in forest.reconstruct(tree).collect()} == {1: "ABCDEFGH", 2: "CxEFG", 3: "EFy"}
    hits = spark.createDataFrame([(7, 1, 0, 8), (8, 1, 0, 2)], "hit_id INT, root_id BIGINT, from0 INT, to0 INT")
    assert {tuple(r)[:4] for r in forest.prune(tree, hits, 0.3).collect()} == {(7, 1, 0, 8), (7, 2, 0, 5), (7, 3, 0, 3), (8, 1, 0, 2)}
    assert {r.node_id for r in forest.prune(tree, hits, 0.9).collect()} == {1}


def test_prune_with_hot_nodes(spark, monkeypatch):
    """All hits against the SQL, with hits on hot nodes in parts."""
    from collections import Counter
    from pathlib import Path

    import __spark_entry__ as entry

    sf, duckdb = Path("/root/testdata/sf0.001"), pytest.importorskip("duckdb")
    if not sf.exists():
        pytest.skip("the given tables aren't here")
    monkeypatch.setattr("seqloom.operators.skew.HOT_ROWS", 5)
    con = duckdb.connect()
    for p in sf.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    rel = con.sql(entry.oracle_sql()["forest_prune"])
    got = entry.queries()["forest_prune"](spark, str(sf)).select(*rel.columns).collect()
    assert len(got) > 100 and Counter(map(tuple, got)) == Counter(rel.fetchall())


def stored_tree(spark, rows):
    import datetime as dt

    full = [(i, p is None, p, None, [], dt.datetime(2021, 1, 1), seq, a, b, diff) for i, p, seq, a, b, diff in rows]
    return spark.createDataFrame(full, "node_id BIGINT, is_root BOOLEAN, parent_id BIGINT, depth INT, children ARRAY<BIGINT>, loaded_at TIMESTAMP, sequence STRING, parent_start INT, parent_end INT, diff ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>")


def test_search_forest(spark):
    """Roots and the nodes below that keep the hit's range, nodes of equal text alike."""
    rng = random.Random(9)
    text = "".join(rng.choice(LETTERS) for _ in range(200))
    other = "".join(rng.choice(LETTERS) for _ in range(200))
    gone = [("DELETE", i, None) for i in range(60)]
    tree = stored_tree(spark, [(1, None, text, None, None, None), (2, 1, None, 20, 180, [("SUBSTITUTE", 3, "W")]), (3, 1, None, 20, 180, [("SUBSTITUTE", 3, "W")]), (4, 1, None, 100, 170, gone), (5, None, other, None, None, None)])
    q = frame(spark, {7: text, 8: "ACD"})
    got = {(r.query_id, r.node_id): (r.sstart, r.send) for r in forest.search_forest(q, tree).collect()}
    assert set(got) == {(7, 1), (7, 2), (7, 3)} and got[7, 1] == (1, 200) and got[7, 2] == got[7, 3]
    assert forest.search_forest(q.limit(0), tree).count() == 0


def test_forest_database(spark, records, tmp_path):
    path = str(tmp_path / "forest")
    ForestDatabase.create(frame(spark, {i: t for i, t in records.items() if i % 2 == 0}), path)
    db = ForestDatabase.open(spark, path)
    odd = frame(spark, {i: t for i, t in records.items() if i % 2})
    db.append(odd.limit(2), "b1")
    db.append(odd, "b1")  # a batch that is run again
    assert {r.seq_id: r.residues for r in db.sequences().collect()} == {i: t for i, t in records.items() if t}
    old = {r.node_id for r in db.nodes.filter("seq_id % 2 = 0").collect()}
    assert any(r.parent_id in old for r in db.nodes.filter("seq_id % 2 = 1").collect())
    with pytest.raises(Exception, match="(?i)exists"):
        ForestDatabase.create(odd, path)


def test_a_batch_written_again(spark, records, tmp_path):
    path = str(tmp_path / "db")
    db = SequenceDatabase.create(frame(spark, {1: records[1]}), path)
    db.append(frame(spark, {i: records[i] for i in (2, 3)}), "s1")
    db.append(frame(spark, {i: records[i] for i in (2, 3, 4)}), "s1")
    assert {r.seq_id: r.residues for r in db.sequences().collect()} == {i: records[i] for i in (1, 2, 3, 4)}
    assert {r.subject_id for r in db.search(frame(spark, {2: records[2]})).collect()} >= {2}
    ids = db.segments.filter("seq_id = 1").select("coarse_id")
    assert db.representatives(ids).count() == 1
    lost = db.segments.withColumn("coarse_id", F.lit("none"))
    with pytest.raises(Exception, match="no representative"):
        compress.decompress(db.coarse, lost).collect()


def roc(rows):
    p = sum(x for _, x in rows)
    n = len(rows) - p
    pts = [(0.0, 0.0)]
    for s in sorted({s for s, _ in rows}, reverse=True):
        pts.append((sum(1 for t, x in rows if t >= s and not x) / n, sum(1 for t, x in rows if t >= s and x) / p))
    return pts, sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))


def test_evaluation(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(9) / 2.0, rng.random() < 0.4) for _ in range(60)]
    df = spark.createDataFrame(rows, "score DOUBLE, positive BOOLEAN")
    pts, area = roc(rows)
    assert sorted((round(r.fpr, 9), round(r.tpr, 9)) for r in evaluate.roc_points(df).collect()) == sorted((round(a, 9), round(b, 9)) for a, b in pts)
    assert evaluate.auc(df).first().auc == pytest.approx(area)
    none = df.filter("positive")
    assert evaluate.auc(none).first().auc is None and evaluate.roc_points(none).count() == 2
    t = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "q INT, s INT")
    f = spark.createDataFrame([(1, 3), (2, 2)], "q INT, s INT")
    assert {tuple(r) for r in evaluate.missed_extra(t, f, ["q", "s"]).collect()} == {(1, 2, "missed"), (2, 2, "extra")}
    assert tuple(evaluate.recall_precision(t, f, ["q", "s"]).first()) == (2, 2, 1, 0.5, 0.5)
    assert tuple(evaluate.recall_precision(t.limit(0), f.limit(0), ["q", "s"]).first()) == (0, 0, 0, 0.0, 0.0)
    # Six of 4 x 5 pairs have scores; one true pair wasn't found.
    held = [(0, 0, 9.0, True), (0, 1, 7.0, False), (0, 1, 5.0, False), (1, 1, 7.0, True), (1, 2, 3.0, True), (2, 2, 0.0, False), (3, 3, None, False)]
    df = spark.createDataFrame(held, "q INT, s INT, x DOUBLE, hit BOOLEAN")
    truth = df.filter("hit").unionByName(spark.createDataFrame([(3, 4, None, True)], df.schema))
    got = evaluate.universe_scores(truth, df, ["q", "s"], "x", 20)
    assert {(r.score, r.positive): r.n for r in got.collect()} == {(9.0, True): 1, (7.0, True): 1, (7.0, False): 1, (3.0, True): 1, (0.0, True): 1, (0.0, False): 15}
    pts, area = roc([(9, True), (7, True), (7, False), (3, True), (0, True)] + [(0, False)] * 15)
    assert evaluate.auc(got).first().auc == pytest.approx(area) and evaluate.roc_points(got).count() == len(pts)
    assert evaluate.universe_scores(truth.limit(0), df.limit(0), ["q", "s"], "x", 0).count() == 0
    ids = spark.range(200).withColumnRenamed("id", "k").selectExpr("k", "CASE WHEN k < 100 THEN 'a' WHEN k < 130 THEN 'b' WHEN k < 135 THEN 'c' END AS fam")
    got = evaluate.family_sample(ids, "fam", "k", 45, per_family=20).groupBy("fam").count().collect()
    assert {r.fam: r["count"] for r in got} == {"a": 20, "b": 20, "c": 5}
    assert evaluate.sample(ids, "k", 7).count() == 7


def test_seeds(spark, monkeypatch):
    df = frame(spark, {1: "ACDEFGHIK", 2: "ACDEFG", 3: "AAAAAAAAAAAA", 4: "ACDEJGHIK", 5: None})
    got = seeds.seed_table(df).collect()
    assert {(r.seq_id, r.pos) for r in got} == {(1, 0), (1, 1), (1, 2)}
    assert {r.reduced for r in seeds.reduced_seeds(df.filter("seq_id = 2")).collect()} == {"32887", "28874"}
    table = spark.createDataFrame([(i, 0, "k") for i in range(50)], "seq_id BIGINT, pos INT, kmer STRING")
    assert {r.seq_id for r in seeds.look_up(table.limit(1), table, "kmer", 32).collect()} == set(range(32))
    monkeypatch.setattr(seeds, "KEY_PART", 7)
    more = table.unionByName(spark.createDataFrame([(90, 3, "j"), (91, 4, None)], table.schema))
    got = [tuple(r) for r in seeds.look_up(more.filter("seq_id IN (0, 90, 91)"), more, "kmer", None).collect()]
    assert sorted(got) == sorted([(0, 0, i, 0) for i in range(50)] + [(90, 3, 90, 3)])


def test_seeds_are_not_broadcast(spark):
    """Look-ups send no seeds through the driver, however small the texts; runs and long texts."""
    df = frame(spark, {1: "ACDEFGHIK" * 300, 2: "ACDEFG", 3: "CDEFAAAAAACDEFGHI", 4: "CDEFA", 5: "AAAACDEFGHIKL"})
    t = seeds.seed_table(df)
    for n in (32, None):
        got = seeds.look_up(t.filter("seq_id % 2 = 1"), t, "kmer_hash", n)
        assert got.count() > 0 and len(got.collect()) == got.count()
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and (n is None or "Broadcast" not in plan)
    assert {r.pos for r in t.filter("seq_id = 3").collect()} == set(range(4))
    assert {r.pos for r in t.filter("seq_id = 5").collect()} == set(range(7))
    calm = {r.pos for r in seeds.seed_table(df, window=7).filter("seq_id = 3").collect()}
    assert calm == set(range(11))


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text("\n\n> one x\nACD\nEF*\n\n>two\n>three\nacdj\n")
    (tmp_path / "b.fasta").write_text(">one x\nK\n")
    got = {(r.file[-7:], r.rec_no, r.header, r.residues) for r in fasta.read_sequences(spark, str(tmp_path)).collect()}
    assert got == {("a.fasta", 0, "one x", "ACDEF"), ("a.fasta", 1, "two", ""), ("a.fasta", 2, "three", "ACDX"), ("b.fasta", 0, "one x", "K")}
    recs = fasta.read_fasta(spark, str(tmp_path))
    assert [r.header for r in fasta.first_records(recs, 2).collect()] == ["one x", "two"]
    assert fasta.record(recs, "one").count() == 2 and fasta.record(recs, "none").count() == 0
    out = str(tmp_path / "out")
    recs = {1: "ACD" * 50, 2: "", 3: "K"}
    fasta.write_fasta(frame(spark, recs).selectExpr("CAST(seq_id AS STRING) AS header", "residues"), out)
    assert {(int(r.header), r.residues) for r in fasta.read_fasta(spark, out).collect()} == set(recs.items())


def test_fasta_errors_and_order(spark, tmp_path):
    (tmp_path / "c.fasta").write_text("ACD\n>one\nK\n")
    with pytest.raises(Exception, match="text before the first >"):
        fasta.read_fasta(spark, str(tmp_path)).collect()
    assert [(r.header, r.residues) for r in fasta.read_fasta(spark, str(tmp_path), strict=False).orderBy("rec_no").collect()] == [("ACD", ""), ("one", "K")]
    recs = {i: "ACD" * (i % 7) for i in range(300)}
    fasta.write_fasta(frame(spark, recs).selectExpr("seq_id", "CAST(seq_id AS STRING) AS header", "residues").repartition(5), str(tmp_path / "out"), order_by="seq_id")
    back = fasta.read_fasta(spark, str(tmp_path / "out")).orderBy("file", "rec_no").collect()
    assert [(int(r.header), r.residues) for r in back] == sorted(recs.items())


def test_tables_and_xml(spark, tmp_path):
    (tmp_path / "h.tsv").write_text("q\ts\t99.0\t10\t0\t0\t1\t10\t2\t11\t1e-5\t50.5\nbad\n")
    rows = fasta.read_hsp_table(spark, str(tmp_path / "h.tsv")).collect()
    assert rows[0].evalue == 1e-5 and rows[1].evalue is None
    hsp = "<Hsp><Hsp_num>1</Hsp_num><Hsp_evalue>1e-9</Hsp_evalue><Hsp_query-from>1</Hsp_query-from><Hsp_query-to>5</Hsp_query-to><Hsp_hit-from>2</Hsp_hit-from><Hsp_hit-to>6</Hsp_hit-to></Hsp>"
    (tmp_path / "r.xml").write_text(f"<BlastOutput><Hit><Hit_num>1</Hit_num><Hit_accession>17</Hit_accession><Hit_hsps>{hsp}{hsp}</Hit_hsps></Hit></BlastOutput>")
    got = [tuple(r) for r in fasta.read_search_xml(spark, str(tmp_path / "r.xml")).collect()]
    assert got == [(1, 17, 1, 1e-9, 1, 5, 2, 6)] * 2
    fasta.write_table(spark.createDataFrame([(1, "x")], "a INT, b STRING"), str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).first().b == "x"


def test_streams(spark, records, tmp_path):
    from seqloom.session import Stage

    folder = tmp_path / "hsp.parquet"
    for i in range(3):
        spark.createDataFrame([("q", 10 * i, 10 * i + 4), ("q", 100, 105 + i), ("r", 1, 1)], "k STRING, lo BIGINT, hi BIGINT").coalesce(1).write.mode("append").parquet(str(folder))
    stream = jobs.parquet_stream(spark, str(tmp_path), "hsp").selectExpr("k", "lo", "hi")
    got = {(r.k, r.lo, r.hi) for r in jobs.stream_intervals(stream, "k", Stage(spark, "test")).collect()}
    assert got == {("q", 0, 4), ("q", 10, 14), ("q", 20, 24), ("q", 100, 107), ("r", 1, 1)}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fasta").write_text("".join(f">{i}\n{t}\n" for i, t in records.items() if i < 10))
    db = SequenceDatabase.create(frame(spark, records).limit(0), str(tmp_path / "db"))
    rows = fasta.stream_fasta(spark, str(tmp_path / "in")).selectExpr("CAST(header AS BIGINT) AS seq_id", "residues")
    jobs.stream_append(rows, db, str(tmp_path / "progress"))
    assert {r.seq_id: r.residues for r in db.sequences().collect()} == {i: t for i, t in records.items() if i < 10}


def test_iterated_takes_every_query(spark, records, tmp_path):
    """Ids that no step divides find themselves and their relatives too."""
    frame(spark, {i: t for i, t in records.items() if i < 10}).write.parquet(f"{tmp_path}/fasta_sequence.parquet")
    found = {(r.query_id, r.subject_id) for r in reference.search_iterated(spark, str(tmp_path)).collect()}
    assert {(i, i) for i in range(10)} <= found and {(1, 2), (2, 1), (7, 8)} <= found


def test_search_blocks(spark, records, monkeypatch):
    """However queries, seeds and members are dealt, hits are the same, and no pair is shuffled."""
    df = frame(spark, records)
    names = df.select("seq_id", F.explode(F.array(F.col("seq_id"), F.col("seq_id") + 1000)).alias("member_id"), F.lit(5).alias("shift"))
    rows = lambda **k: sorted(tuple(r) for r in search.search(df, df, **k).collect())
    whole, named = rows(), rows(members=names)
    plan = search.search(df, df)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Exchange") and "Window" not in plan
    assert named == sorted((*r[:1], i, *r[2:7], r[7] + 5, r[8] + 5) for r in whole for i in (r[1], r[1] + 1000))
    for name, n in (("QUERY_BLOCK", 300), ("MET", 3), ("MEMBERS", 1), ("SEED_PART", 2)):
        monkeypatch.setattr(search, name, n)
    assert rows() == whole and rows(members=names) == named
    assert {r[:2] for r in rows(p=search.SearchParams(self_pairs=False))} == {r[:2] for r in whole if r[0] != r[1]}
    assert {r[:2] for r in whole} >= {(i, i) for i in range(20)} and not any(r[0] == 101 for r in whole)
