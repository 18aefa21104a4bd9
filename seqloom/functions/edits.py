"""Edit scripts as columns: build, text form, parse, apply; forest operations likewise.

A flat script is array<struct<kind, start, end, residues>> against the unaligned text: kind s
(substitution), d (deletion) or i (insertion), start and end 0-based in the old text. Forest
operations are array<struct<op, pos, ch>>, one per residue.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCRIPT = "ARRAY<STRUCT<kind: STRING, start: INT, end: INT, residues: STRING>>"
OPERATIONS = "ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _letters(c: Column | str) -> Column:
    return F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.expr("CAST(array() AS ARRAY<STRING>)"))


def _place(old: Column, i: Column) -> Column:
    """Place in the unaligned old text of column i of an alignment."""
    return F.when(F.instr(old, "-") == 0, i).otherwise(F.length(F.replace(old.substr(F.lit(1), i), F.lit("-"), F.lit(""))))


def build(old: Column | str, new: Column | str) -> Column:
    """Script of two aligned texts of one length (gaps are `-`): runs of one kind are one entry."""
    old, new = _col(old), _col(new)
    kinds = F.zip_with(_letters(old), _letters(new), lambda a, b: F.when(a == b, "=").when(a == "-", "i").when(b == "-", "d").otherwise("s"))
    changes = lambda ks: F.transform(ks, lambda k, i: F.when((i == 0) | (k != F.get(ks, i - 1)), F.struct(k.alias("kind"), i.alias("i"))))
    runs = F.filter(once(kinds, changes), lambda x: x.isNotNull())

    def entries(r: Column) -> Column:
        def entry(x: Column, j: Column) -> Column:
            n = F.coalesce(F.get(r, j + 1)["i"], F.length(old)) - x["i"]
            start = _place(old, x["i"])
            end = F.when(x["kind"] == "i", start).otherwise(start + n)
            return F.struct(x["kind"].alias("kind"), start.alias("start"), end.alias("end"), F.when(x["kind"] == "d", "").otherwise(new.substr(x["i"] + 1, n)).alias("residues"))

        return F.filter(F.transform(r, entry), lambda m: m["kind"] != "=")

    return once(runs, entries)


def once(value: Column, f) -> Column:
    """f(value), where f may name the value often and it is still worked out once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def to_text(script: Column | str) -> Column:
    """<kind><distance from the last start><residues>; deletions as so many `-`."""
    body = lambda m: F.when(m["kind"] == "d", F.repeat(F.lit("-"), m["end"] - m["start"])).otherwise(F.upper(m["residues"]))

    def text(mods: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(mods, i - 1)["start"])
        return F.array_join(F.transform(mods, lambda m, i: F.concat(m["kind"], (m["start"] - before(i)).cast("string"), body(m))), "")

    return once(_col(script), text)


def parse(text: Column | str) -> Column:
    """The script of a text form; null if the text isn't one."""
    text = _col(text)
    entry = r"([sid])([0-9]+)([^sid0-9]+)"
    kinds, steps, bodies = (F.regexp_extract_all(text, F.lit(entry), F.lit(g)) for g in (1, 2, 3))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda s, n: F.struct(F.concat(s["out"], (s["at"] + n.cast("int")).cast("string"), F.lit(",")).alias("out"), (s["at"] + n.cast("int")).alias("at"))
    starts = F.split(F.aggregate(steps, start, step, lambda s: s["out"]), ",")
    parts = F.arrays_zip(kinds.alias("k"), bodies.alias("b"))

    def mod(x: Column, at: Column) -> Column:
        end = F.when(x["k"] == "i", at).otherwise(at + F.length(x["b"]))
        return F.struct(x["k"].alias("kind"), at.alias("start"), end.alias("end"), F.when(x["k"] == "d", "").otherwise(x["b"]).alias("residues"))

    mods = once(starts, lambda at: F.transform(parts, lambda x, i: mod(x, F.get(at, i).cast("int"))))
    return F.when(text.rlike(rf"^({entry})*$"), mods)


def apply(script: Column | str, old: Column | str) -> Column:
    """The new text: old residues up to each entry, its residues, and on from its end."""
    script, old = _col(script), _col(old)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))
    step = lambda s, m: F.struct(F.concat(s["out"], old.substr(s["last"] + 1, F.greatest(m["start"] - s["last"], F.lit(0))), m["residues"]).alias("out"), m["end"].alias("last"))
    return F.aggregate(script, start, step, lambda s: F.concat(s["out"], old.substr(s["last"] + 1, F.length(old))))


def forest_ops(old: Column | str, new: Column | str) -> Column:
    """One INSERT, DELETE or SUBSTITUTE per differing column, at its place in the old text."""
    old = _col(old)
    pairs = F.zip_with(_letters(old), _letters(new), lambda a, b: F.when(a != b, F.struct(a.alias("a"), b.alias("b"))))
    at = F.filter(F.transform(pairs, lambda p, i: F.when(p.isNotNull(), F.struct(p["a"].alias("a"), p["b"].alias("b"), _place(old, i).alias("pos")))), lambda p: p.isNotNull())
    return F.transform(at, lambda p: F.struct(F.when(p["a"] == "-", "INSERT").when(p["b"] == "-", "DELETE").otherwise("SUBSTITUTE").alias("op"), p["pos"].alias("pos"), F.when(p["b"] != "-", p["b"]).alias("ch")))


def apply_forest(ops: Column | str, old: Column | str) -> Column:
    """At each place all insertions in order, then the first deletion or substitution; a
    place behind the end takes insertions. Null operations change nothing."""
    ops, old = F.coalesce(_col(ops), F.expr("CAST(array() AS ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>)")), _col(old)
    known = F.filter(ops, lambda o: (o["pos"] >= 0) & (o["pos"] <= F.length(old)))
    ordered = F.array_sort(F.transform(known, lambda o, i: F.struct(o["pos"].alias("pos"), (o["op"] != "INSERT").alias("late"), i.alias("i"), (o["op"] == "DELETE").alias("cut"), F.coalesce(o["ch"], F.lit("")).alias("ch"))))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("last"))

    def step(s: Column, o: Column) -> Column:
        before = old.substr(s["last"] + 1, F.greatest(o["pos"] - s["last"], F.lit(0)))
        over = o["late"] & ((o["pos"] < s["last"]) | (o["pos"] == F.length(old)))  # changed already, or nothing there
        ch = F.when(o["late"] & o["cut"], "").otherwise(o["ch"])
        last = F.when(o["late"], o["pos"] + 1).otherwise(F.greatest(o["pos"], s["last"]))
        return F.when(over, s).otherwise(F.struct(F.concat(s["out"], before, ch).alias("out"), last.alias("last")))

    return F.when(F.size(ops) == 0, old).otherwise(F.aggregate(ordered, start, step, lambda s: F.concat(s["out"], old.substr(s["last"] + 1, F.length(old)))))


def disruption(ops: Column | str, shift: Column | str, lo: Column | str, hi: Column | str) -> Column:
    """Operations whose place, moved by `shift`, lies in [lo, hi); a deletion counts twice."""
    shift, lo, hi = _col(shift), _col(lo), _col(hi)
    inside = F.filter(ops, lambda o: (o["pos"] + shift >= lo) & (o["pos"] + shift < hi))
    return F.aggregate(F.coalesce(inside, F.expr("CAST(array() AS ARRAY<STRUCT<op: STRING, pos: INT, ch: STRING>>)")), F.lit(0), lambda s, o: s + F.when(o["op"] == "DELETE", 2).otherwise(1))
