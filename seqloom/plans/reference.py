"""Queries of the reference's own operators over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import align, edits, residue
from seqloom.functions.text import clean_residues, first_word
from seqloom.operators import compress, evaluate, forest, hierarchy, intervals, search, seeds
from seqloom.session import Stage
from seqloom.sources import fasta
from seqloom.sources.database import ForestDatabase, SequenceDatabase
from seqloom.sources.tables import table
from seqloom.streaming import jobs

#: Searches but search_iterated take every sequence whose id is divisible by this as a query.
QUERY_STEP = 20
PRUNE = 0.3


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, residues: clean, masked, one row per id."""
    raw = table(spark, sf_dir, "fasta_sequence").filter("seq_id IS NOT NULL")
    return raw.groupBy("seq_id").agg(F.max(residue.mask(clean_residues("residues"))).alias("residues"))


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, a, b: each sequence and the one with the next id, side by side; the shorter is
    filled up with gaps, so that scripts insert or delete what the other has more."""
    s = sequences(spark, sf_dir)
    nxt = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("residues").alias("next"))
    n = F.greatest(F.length("residues"), F.length("next"))
    full = lambda c: F.rpad(F.col(c), n, F.lit("-"))
    return s.join(nxt, "seq_id").select("seq_id", full("residues").alias("a"), full("next").alias("b"))


def seq_normalise(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", "residues", F.length("residues").cast("long").alias("n"))


def fasta_wrap60(spark, sf_dir):
    return sequences(spark, sf_dir).select("seq_id", residue.wrap("residues").alias("lines"))


def fasta_roundtrip(spark, sf_dir):
    stage = Stage(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf_dir).select("seq_id", F.col("seq_id").cast("string").alias("header"), "residues"), f"{stage.root}/out", order_by="seq_id")
    back = fasta.read_sequences(spark, f"{stage.root}/out")
    return back.select(F.col("header").cast("long").alias("seq_id"), "residues")


def fasta_numbering(spark, sf_dir):
    """Records per file after writing and reading: numbers run from 0 without holes."""
    stage = Stage(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("header"), "residues"), f"{stage.root}/out")
    per = fasta.read_fasta(spark, f"{stage.root}/out").groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("rec_no").alias("top"), F.count_distinct("rec_no").alias("d"))
    return per.agg(F.sum("n").alias("n_records"), F.sum((F.col("n") - 1 - F.col("top")) + (F.col("n") - F.col("d"))).alias("n_wrong"))


def fasta_stream(spark, sf_dir):
    """The sequences, written as FASTA files, that are then read as a stream."""
    stage = Stage(spark, "fasta")
    fasta.write_fasta(sequences(spark, sf_dir).select(F.col("seq_id").cast("string").alias("header"), "residues"), f"{stage.root}/in")
    return jobs.stream_table(fasta.stream_fasta(spark, f"{stage.root}/in"), stage).select(F.col("header").cast("long").alias("seq_id"), "residues")


def header_accession(spark, sf_dir):
    raw = table(spark, sf_dir, "fasta_sequence")
    return raw.select("seq_id", residue.accession("header").alias("accession"), residue.gene_family("header").alias("family")).distinct()


def kmer_counts(spark, sf_dir):
    found = sequences(spark, sf_dir).select(F.explode(residue.kmers("residues", 4)).alias("x"))
    return found.groupBy(F.col("x.kmer").alias("kmer")).agg(F.count(F.lit(1)).alias("n"))


def kmer_hashes(spark, sf_dir):
    k = table(spark, sf_dir, "seed_loc").select(F.upper("kmer").alias("kmer")).filter("kmer IS NOT NULL").distinct()
    h = k.select("kmer", residue.kmer_hash("kmer").alias("kmer_hash"))
    return h.select("kmer", "kmer_hash", residue.unhash_kmer("kmer_hash", 4).alias("back"))


def kmer_reduced(spark, sf_dir):
    return seeds.reduced_seeds(sequences(spark, sf_dir)).groupBy("reduced").agg(F.count(F.lit(1)).alias("n"))


def seed_table_flat(spark, sf_dir):
    return seeds.seed_table(sequences(spark, sf_dir)).groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_seeds"), F.sum("kmer_hash").alias("hashes"))


def seed_lookup(spark, sf_dir):
    """Hits of look-ups (32 a seed) of every 20th sequence, per pair of sequences."""
    t = seeds.seed_table(sequences(spark, sf_dir))
    got = seeds.look_up(t.filter(F.col("seq_id") % QUERY_STEP == 0), t, "kmer_hash")
    return got.groupBy("query_id", "seq_id").agg(F.count(F.lit(1)).alias("n_hits"))


def seed_lookup_all(spark, sf_dir):
    """The same without a limit: all places of every seed."""
    t = seeds.seed_table(sequences(spark, sf_dir))
    got = seeds.look_up(t.filter(F.col("seq_id") % QUERY_STEP == 0), t, "kmer_hash", None)
    return got.groupBy("query_id", "seq_id").agg(F.count(F.lit(1)).alias("n_hits"))


def low_complexity_runs(spark, sf_dir):
    r = sequences(spark, sf_dir).select("seq_id", residue.runs("residues", 10).alias("runs"), residue.low_complexity_skip("residues", 40, 10).cast("long").alias("skip"))
    return r.select("seq_id", F.size("runs").cast("long").alias("n_runs"), F.coalesce(F.array_max(F.transform("runs", F.length)), F.lit(0)).cast("long").alias("longest"), "skip")


def identity(spark, sf_dir):
    p = _neighbours(spark, sf_dir)
    return p.select("seq_id", residue.identity_pct("a", "b").cast("long").alias("percent"), residue.matches("a", "b").cast("long").alias("n_equal"), F.round(residue.identity_frac("a", "b"), 6).alias("fraction"))


def best_diagonal(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("seq_id", F.round(residue.best_diagonal("a", "b", 5), 6).alias("share"))


def edit_text(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("seq_id", edits.to_text(edits.build("a", "b")).alias("script"))


def edit_roundtrip(spark, sf_dir):
    script = edits.parse(edits.to_text(edits.build("a", "b")))
    return _neighbours(spark, sf_dir).select("seq_id", edits.apply(script, _ungapped("a")).alias("residues"))


def edit_forest_roundtrip(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("seq_id", edits.apply_forest(edits.forest_ops("a", "b"), _ungapped("a")).alias("residues"))


def _ungapped(c):
    return F.replace(c, F.lit("-"), F.lit(""))


def _nw(spark, sf_dir):
    s = sequences(spark, sf_dir)
    nxt = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("residues").alias("b"))
    return align.align_pairs(s.withColumnRenamed("residues", "a").join(nxt, "seq_id"), "a", "b", residue.rule_matrix())


def nw_alignment(spark, sf_dir):
    """Each sequence aligned with the next, and both again without the gaps."""
    got = _nw(spark, sf_dir)
    return got.select("seq_id", F.replace("aligned_a", F.lit("-"), F.lit("")).alias("a"), F.replace("aligned_b", F.lit("-"), F.lit("")).alias("b"), (F.length("aligned_a") == F.length("aligned_b")).alias("even"))


def nw_columns(spark, sf_dir):
    """Columns, equal columns and gaps of those alignments."""
    got, gaps = _nw(spark, sf_dir), lambda c: F.length(c) - residue.ungapped_length(c)
    return got.select("seq_id", F.length("aligned_a").alias("n_columns"), residue.matches("aligned_a", "aligned_b").alias("n_equal"), gaps("aligned_a").alias("gaps_a"), gaps("aligned_b").alias("gaps_b"))


def flat_roundtrip(spark, sf_dir):
    coarse, segments = compress.compress_flat(sequences(spark, sf_dir))
    return compress.decompress(coarse, segments)


def flat_ratio(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return compress.ratio(compress.compress_flat(s)[0], s)


def flat_segments(spark, sf_dir):
    return compress.compress_flat(sequences(spark, sf_dir))[1].select("seq_id", "q_from", "coarse_id", "c_start", "c_end", edits.to_text("diff").alias("script"))


def forest_roundtrip(spark, sf_dir):
    return compress.restore_forest(compress.compress_forest(sequences(spark, sf_dir)))


def forest_shape(spark, sf_dir):
    return compress.compress_forest(sequences(spark, sf_dir)).groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.col("q_to") - F.col("q_from")).alias("n_residues"))


def forest_depths(spark, sf_dir):
    """Depth histogram of the stored forest, by its real depths."""
    return hierarchy.decompose(table(spark, sf_dir, "tree_node")).nodes.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count(F.lit(1)).alias("n_nodes"))


def forest_reconstruct(spark, sf_dir):
    return forest.reconstruct(table(spark, sf_dir, "tree_node"))


def _root_hits(spark, sf_dir):
    hits = table(spark, sf_dir, "search_hit").select("hit_id", F.col("node_id").alias("root_id"), (F.col("sstart") - 1).alias("from0"), F.col("send").alias("to0"))
    return hits.distinct()


def _pruned(spark, sf_dir):
    return forest.prune(table(spark, sf_dir, "tree_node"), _root_hits(spark, sf_dir), PRUNE)


def forest_prune(spark, sf_dir):
    return _pruned(spark, sf_dir).select("hit_id", "node_id", F.col("from0").cast("long").alias("from0"), F.col("to0").cast("long").alias("to0"))


def prune_scores(spark, sf_dir):
    """Per node the highest score with which it was kept, and the number of hits."""
    return _pruned(spark, sf_dir).groupBy("node_id").agg(F.max(F.round("score", 9)).alias("top_score"), F.count(F.lit(1)).alias("n_hits"))


def candidate_dedupe(spark, sf_dir):
    hits = table(spark, sf_dir, "search_hit").filter("sstart IS NOT NULL AND send IS NOT NULL AND node_id IS NOT NULL").select("node_id", (F.col("sstart") - 1).alias("from0"), F.col("send").alias("to0"))
    return search.widest(hits)


def align_once(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return search.representatives(s.select(F.col("seq_id").alias("node_id"), F.col("residues").alias("sequence")))


def align_once_fanout(spark, sf_dir):
    """Search rows on representatives, for each record that shares the text."""
    members = align_once(spark, sf_dir)
    hsp = table(spark, sf_dir, "hsp").select(first_word("qseqid").alias("qseqid"), F.col("accession").cast("long").alias("rep_id"), "hsp_num", "hit_num").distinct()
    return search.fan_out(hsp, members).groupBy("node_id").agg(F.count(F.lit(1)).alias("n_hits"))


def expand_overlap(spark, sf_dir):
    """Search rows against segments of 100 residues of each record."""
    s = sequences(spark, sf_dir).filter("residues <> ''")
    seg = s.select(F.col("seq_id").alias("coarse_id"), F.explode(F.sequence(F.lit(0), F.floor((F.length("residues") - 1) / 100))).alias("t"), F.length("residues").alias("n"))
    seg = seg.select("coarse_id", F.col("t").alias("seq_id"), (F.col("t") * 100).alias("c_start"), F.least(F.col("t") * 100 + 100, F.col("n")).alias("c_end"))
    ok = table(spark, sf_dir, "hsp").filter("hit_from IS NOT NULL AND hit_to IS NOT NULL")
    hits = ok.select(F.concat_ws(" ", first_word("qseqid"), F.col("accession").cast("string")).alias("query_id"), F.col("accession").cast("long").alias("coarse_id"), F.least("hit_from", "hit_to").alias("s_from"), F.greatest("hit_from", "hit_to").alias("s_to"))
    return search.expand(hits, seg).select("query_id", F.col("seq_id").cast("long").alias("tile"))


def _pairs(spark, sf_dir):
    hits = table(spark, sf_dir, "search_hit").filter("qseqid IS NOT NULL AND fasta_ref IS NOT NULL AND bitscore IS NOT NULL AND NOT isnan(evalue) AND evalue >= 0")
    return hits.select(first_word("qseqid").alias("query"), residue.accession("fasta_ref").alias("subject"), "evalue", "bitscore")


_PAIR = ["query", "subject"]


def best_hit_per_pair(spark, sf_dir):
    return evaluate.best_scores(_pairs(spark, sf_dir), _PAIR, "bitscore")


def missed_extra(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return evaluate.missed_extra(p.filter("evalue <= 1e-30"), p.filter("bitscore >= 150"), _PAIR)


def recall_precision(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    r = evaluate.recall_precision(p.filter("evalue <= 1e-30"), p.filter("bitscore >= 150"), _PAIR)
    return r.select("n_true", "n_found", "n_hit", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"))


def _scored(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy(*_PAIR).agg(F.max("bitscore").alias("score"), (F.min("evalue") <= 1e-30).alias("positive"))


def roc_points(spark, sf_dir):
    return evaluate.roc_points(_scored(spark, sf_dir)).select(F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


def roc_auc(spark, sf_dir):
    return evaluate.auc(_scored(spark, sf_dir)).select(F.round("auc", 9).alias("auc"))


def roc_universe(spark, sf_dir):
    """The area over all pairs of a query and a subject; those without a hit score 0."""
    p = _pairs(spark, sf_dir)
    size = p.agg(F.count_distinct("query"), F.count_distinct("subject")).first()
    truth = p.filter("evalue <= 1e-30").select(*_PAIR).distinct()
    scored = evaluate.universe_scores(truth, p.filter("bitscore >= 150"), _PAIR, "bitscore", size[0] * size[1])
    return evaluate.auc(scored).select(F.lit(size[0] * size[1]).cast("long").alias("n_pairs"), F.lit(truth.count()).cast("long").alias("n_true"), F.round("auc", 9).alias("auc"))


def family_dense_sample(spark, sf_dir):
    raw = table(spark, sf_dir, "fasta_sequence").filter("seq_id IS NOT NULL").groupBy("seq_id").agg(F.max("header").alias("header"))
    got = evaluate.family_sample(raw.select("seq_id", residue.gene_family("header").alias("family")), "family", "seq_id", 500, 20)
    return got.select("seq_id", "family", F.col("family_rank").cast("long").alias("family_rank"))


def hash_sample(spark, sf_dir):
    return evaluate.sample(sequences(spark, sf_dir).select("seq_id"), "seq_id", 200)


def search_sequences(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return search.search(s.filter(F.col("seq_id") % QUERY_STEP == 0), s)


def search_flat(spark, sf_dir):
    s = sequences(spark, sf_dir)
    coarse, segments = compress.compress_flat(s)
    return search.search_compressed(s.filter(F.col("seq_id") % QUERY_STEP == 0), coarse, segments, s)


def search_iterated(spark, sf_dir):
    """Every sequence as a query against all."""
    s = sequences(spark, sf_dir)
    return search.search_iterated(s, s, 2)


def profile_counts(spark, sf_dir):
    s = sequences(spark, sf_dir)
    return search.profile_counts(search.search(s.filter(F.col("seq_id") % QUERY_STEP == 0), s), s)


def search_forest(spark, sf_dir):
    """The stored forest, searched with the text of every node whose id is divisible by 20."""
    tree, stage = table(spark, sf_dir, "tree_node"), Stage(spark, "queries")
    q = forest.reconstruct(tree).filter(F.col("node_id") % QUERY_STEP == 0)
    return forest.search_forest(stage.save(q.select(F.col("node_id").alias("seq_id"), F.col("sequence").alias("residues")), "queries"), tree)


def matched_roots(spark, sf_dir):
    """Distinct nodes that the hits name, and those of them that are ends of chains of parents."""
    hits = table(spark, sf_dir, "search_hit").filter("node_id IS NOT NULL").select("node_id").distinct()
    tops = hierarchy.decompose(table(spark, sf_dir, "tree_node"), segments=False).nodes.filter("depth = 0").select("node_id", F.lit(1).alias("top"))
    return hits.join(tops, "node_id", "left").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("top").alias("n_roots"))


def forest_ratio(spark, sf_dir):
    """Roots, children and their share of the stored forest's nodes."""
    nodes = hierarchy.decompose(table(spark, sf_dir, "tree_node"), segments=False).nodes
    n = nodes.agg(F.count_if(F.col("depth") == 0).alias("n_roots"), F.count_if(F.col("depth") > 0).alias("n_children"))
    return n.select("n_roots", "n_children", F.round(F.col("n_children") / (F.col("n_roots") + F.col("n_children")), 9).alias("child_ratio"))


def forest_db_append(spark, sf_dir):
    """A forest of the even ids, to which the odd ones are added, given back."""
    s, stage = sequences(spark, sf_dir), Stage(spark, "fdb")
    ForestDatabase.create(s.filter("seq_id % 2 = 0"), f"{stage.root}/db").append(s.filter("seq_id % 2 = 1"), "odd")
    return ForestDatabase.open(spark, f"{stage.root}/db").sequences()


def db_append(spark, sf_dir):
    """A database of the even ids, to which the odd ones are appended, given back."""
    s, stage = sequences(spark, sf_dir), Stage(spark, "db")
    db = SequenceDatabase.create(s.filter("seq_id % 2 = 0"), f"{stage.root}/db")
    db.append(s.filter("seq_id % 2 = 1"))
    return SequenceDatabase.open(spark, f"{stage.root}/db").sequences()


def stream_append(spark, sf_dir):
    """An empty database to which a stream of records is appended, given back."""
    stage = Stage(spark, "stream")
    db = SequenceDatabase.create(sequences(spark, sf_dir).filter("false"), f"{stage.root}/db")
    rows = jobs.parquet_stream(spark, sf_dir, "fasta_sequence").filter("seq_id IS NOT NULL")
    jobs.stream_append(rows.select("seq_id", residue.mask(clean_residues("residues")).alias("residues")), db, f"{stage.root}/progress")
    return db.sequences()


def stream_periods(spark, sf_dir):
    """Covered stretches per query, kept in streaming state."""
    stage = Stage(spark, "stream")
    rows = jobs.parquet_stream(spark, sf_dir, "hsp").filter("query_from IS NOT NULL AND query_to IS NOT NULL")
    rows = rows.select(first_word("qseqid").alias("qseqid"), F.least("query_from", "query_to").cast("long").alias("lo"), F.greatest("query_from", "query_to").cast("long").alias("hi"))
    return intervals.stitch(jobs.stream_intervals(rows, "qseqid", stage), ["qseqid"]).select("qseqid", F.col("lo").alias("period_from"), F.col("hi").alias("period_to"))


QUERIES = {
    f.__name__: f
    for f in (
        seq_normalise, fasta_wrap60, fasta_roundtrip, fasta_numbering, fasta_stream, header_accession, kmer_counts, kmer_hashes, kmer_reduced, seed_table_flat, seed_lookup, seed_lookup_all, low_complexity_runs, identity,
        best_diagonal, edit_text, edit_roundtrip, edit_forest_roundtrip, nw_alignment, nw_columns, flat_roundtrip, flat_ratio, flat_segments, forest_roundtrip, forest_shape, forest_depths, forest_reconstruct, forest_prune, prune_scores, candidate_dedupe,
        align_once, align_once_fanout, expand_overlap, best_hit_per_pair, missed_extra, recall_precision, roc_points, roc_auc, roc_universe, family_dense_sample, hash_sample, search_sequences, search_flat, search_iterated, profile_counts,
        search_forest, matched_roots, forest_ratio, forest_db_append, db_append, stream_append, stream_periods,
    )
}

from seqloom.plans.reference_sql import SQL  # noqa: E402, F401
