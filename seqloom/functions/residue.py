"""Residue, k-mer and identity functions as Spark columns, which don't leave the JVM; scores of
residue pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. The residue alphabet in index order: no J, O or U.
ALPHABET = "ABCDEFGHIKLMNPQRSTVWXYZ"
# Fixed values. The reduced alphabet: letters and the group that each falls in.
REDUCED_LETTERS = "LVIMCAGSTPFYWEDNQBZKRH"
REDUCED_GROUPS = "1111234556777888888990"


def rule_matrix(same: int = 5, group: int = 1, other: int = -3) -> np.ndarray:
    """Scores by rule for all byte values: equal letters, letters of one reduced group, others."""
    m = np.full((128, 128), other, np.int32)
    groups = dict(zip(REDUCED_LETTERS, REDUCED_GROUPS))
    for a in ALPHABET:
        for b in ALPHABET:
            if a == b:
                m[ord(a), ord(b)] = same
            elif a in groups and groups.get(a) == groups.get(b):
                m[ord(a), ord(b)] = group
    return m


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def drop_stops(c: Column | str) -> Column:
    """Upper case without stop marks."""
    return F.regexp_replace(F.upper(c), r"\*", "")


def mask(c: Column | str) -> Column:
    """Letters outside the alphabet as X."""
    return F.translate(c, "JOU", "XXX")


def reduce_alphabet(c: Column | str) -> Column:
    """Groups of the reduced alphabet; other letters stay as they are."""
    return F.translate(c, REDUCED_LETTERS, REDUCED_GROUPS)


#: Positions per piece of a text: a substring costs time in proportion to where it begins.
_PIECE = 512


def kmers(c: Column | str, k: int, last: bool = True) -> Column:
    """array<struct<pos, kmer>> of all windows of k; last=False leaves out the final window.
    Windows are cut from pieces of the text, so that long texts don't cost their square."""
    c = _col(c)
    top = F.length(c) - k - (0 if last else 1)

    def piece(at: Column) -> Column:
        part = F.array(c.substr(at + 1, F.lit(_PIECE + k - 1)))
        windows = lambda t: F.transform(F.sequence(F.lit(0), F.least(top - at, F.lit(_PIECE - 1))), lambda i: F.struct((at + i).alias("pos"), t.substr(i + 1, F.lit(k)).alias("kmer")))
        return F.element_at(F.transform(part, windows), 1)

    found = F.flatten(F.transform(F.sequence(F.lit(0), top, F.lit(_PIECE)), piece))
    return F.when(top >= 0, found).otherwise(F.expr("CAST(array() AS ARRAY<STRUCT<pos: INT, kmer: STRING>>)"))


def kmer_hash(c: Column | str) -> Column:
    """Base-23 number of a k-mer (k <= 13); null if a letter is outside the alphabet."""
    c = _col(c)
    digit = F.create_map(*[F.lit(x) for i, a in enumerate(ALPHABET) for x in (a, i)])
    number = F.aggregate(F.split(c, ""), F.lit(0).cast("long"), lambda acc, x: acc * len(ALPHABET) + F.element_at(digit, x))
    return F.when(c.rlike(f"^[{ALPHABET}]+$"), number)


def unhash_kmer(h: Column | str, k: int) -> Column:
    """The k-mer of a base-23 number."""
    h, n = _col(h), len(ALPHABET)
    letter = lambda i: F.substr(F.lit(ALPHABET), (F.floor(h / F.lit(n**i)) % n + 1).cast("int"), F.lit(1))
    return F.concat(*[letter(i) for i in range(k - 1, -1, -1)])


def wrap(c: Column | str, width: int = 60) -> Column:
    """Lines of `width`, each ended by a line break; an empty text gives ''."""
    c = _col(c)
    return F.when(F.length(c) > 0, F.regexp_replace(c, f"(.{{1,{width}}})", "$1\n")).otherwise("")


def accession(c: Column | str) -> Column:
    """Cut at the first colon, first word, and of tr|ACC|NAME or sp|ACC|NAME the second part."""
    head = F.regexp_extract(F.split_part(c, F.lit(":"), F.lit(1)), r"^\s*(\S*)", 1)
    inner = F.split_part(head, F.lit("|"), F.lit(2))
    return F.when(head.rlike(r"^(tr|sp)\|") & (inner != ""), inner).otherwise(head)


def gene_family(c: Column | str) -> Column:
    """The word behind GN=, or null."""
    return F.nullif(F.regexp_extract(c, r"GN=(\S+)", 1), F.lit(""))


def matches(a: Column | str, b: Column | str) -> Column:
    """Positions at which both texts have the same letter."""
    pair = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x == y).cast("int"))
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(both, F.aggregate(pair, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))).otherwise(0)


def identity_pct(a: Column | str, b: Column | str) -> Column:
    """Whole percent of equal positions of texts of one length; 0 for empty ones, null if
    the lengths differ."""
    n = F.length(a)
    return F.when(n != F.length(b), None).when(n == 0, 0).otherwise(F.floor(matches(a, b) * 100 / F.greatest(n, F.lit(1))).cast("int"))


def identity_frac(a: Column | str, b: Column | str) -> Column:
    """Share of equal columns of an alignment; gaps count in the denominator."""
    return F.when(F.length(a) == 0, 0.0).otherwise(matches(a, b) / F.greatest(F.length(a), F.lit(1)))


def ungapped_length(c: Column | str) -> Column:
    return F.length(F.replace(c, F.lit("-"), F.lit("")))


def repetitive(c: Column | str) -> Column:
    """At least two letters, all the same."""
    c = _col(c)
    return (F.length(c) > 1) & (F.length(F.replace(c, c.substr(1, 1), F.lit(""))) == 0)


def runs(c: Column | str, least: int) -> Column:
    """array<string> of the runs of one letter of at least `least`, from left to right."""
    return F.transform(F.regexp_extract_all(c, F.lit(rf"((.)\2{{{least - 1},}})"), F.lit(1)), lambda x: x)


def low_complexity_skip(c: Column | str, window: int, region: int) -> Column:
    """Offset behind the first run of at least `region` equal letters whose first `region`
    letters end within the first window + region letters; 0 if there is none."""
    c = _col(c)
    head = c.substr(1, window + region)
    at = F.regexp_instr(head, F.lit(rf"(.)\1{{{region - 1},}}"))
    run = F.length(F.regexp_extract(c.substr(at, F.length(c)), r"^((.)\2*)", 1))
    return F.when(at > 0, at - 1 + run).otherwise(0)


def best_diagonal(a: Column | str, b: Column | str, band: int) -> Column:
    """Largest share of equal letters among the diagonals -band..band, over their overlap."""
    a, b = _col(a), _col(b)

    def share(d: Column) -> Column:
        n = F.least(F.length(a) - F.greatest(-d, F.lit(0)), F.length(b) - F.greatest(d, F.lit(0)))
        x, y = a.substr(F.greatest(-d, F.lit(0)) + 1, n), b.substr(F.greatest(d, F.lit(0)) + 1, n)
        return F.when(n > 0, matches(x, y) / F.greatest(n, F.lit(1))).otherwise(0.0)

    return F.array_max(F.transform(F.sequence(F.lit(-band), F.lit(band)), share))
