"""Registered queries against their SQL on the smallest given tables, where they are there."""

from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry

SF = Path("/root/testdata/sf0.001")
QUICK = ["p2_found", "p2_per_key", "p2_percentiles", "p4_found", "p4_periods", "seq_normalise", "fasta_wrap60", "header_accession", "kmer_counts", "kmer_hashes", "seed_table_flat", "low_complexity_runs", "identity", "edit_text", "expand_overlap", "missed_extra", "roc_points", "roc_auc", "family_dense_sample"]


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {f"p{n}_found" for n in (1, 2, 4)} <= set(queries)
    assert all(callable(f) for f in queries.values())


def test_core_does_not_import_llm():
    root = Path(entry.__file__).parent / "seqloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "seqloom.llm" not in p.read_text(), p


@pytest.mark.skipif(not SF.exists(), reason="the given tables aren't here")
@pytest.mark.parametrize("name", QUICK)
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df, rel = entry.queries()[name](spark, str(SF)), con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    norm = lambda v: f"{v:.9g}" if isinstance(v, float) else v
    mine = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert mine == Counter(tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
