"""Pitch-class functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the twelve pitch classes.
NAMES = ["C", "Db", "D", "Eb", "E", "F", "F#", "G", "Ab", "A", "Bb", "B"]
#: Intervals of the four triad types: major, minor, augmented, diminished.
TRIADS = [[0, 4, 7], [0, 3, 7], [0, 4, 8], [0, 3, 6]]
#: Pitch classes of letters.
LETTERS = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pc_set(pitches) -> Column:
    """Distinct pitch classes in order."""
    return F.array_sort(F.array_distinct(F.transform(_col(pitches), lambda x: F.pmod(x, F.lit(12)))))


def pitch_name(pc) -> Column:
    names = F.array(*map(F.lit, NAMES))
    return F.get(names, F.pmod(_col(pc), F.lit(12)).cast("int"))


def index_to_pc_set(index) -> Column:
    """Chord number: root modulo 12, type by twelves."""
    i = _col(index)
    shapes = F.array(*[F.array(*map(F.lit, t)) for t in TRIADS])
    shape = F.get(shapes, F.floor(i / 12).cast("int"))
    return F.array_sort(F.transform(shape, lambda x: F.pmod(x + i, F.lit(12)).cast("int")))


def pc_set_label(pcs) -> Column:
    """Root and quality of a triad in any inversion; null for an empty set."""
    p = _col(pcs)
    gap = lambda a, i: F.pmod(F.get(a, i + 1) - F.get(a, i), F.lit(12))
    left = F.concat(F.slice(p, 2, 2), F.slice(p, 1, 1))
    right = F.concat(F.slice(p, 3, 1), F.slice(p, 1, 2))
    t = F.when(gap(p, 0) > 4, left).when(gap(p, 1) > 4, right).otherwise(p)
    root = F.get(t, 0)
    third, fifth = F.pmod(F.get(t, 1) - root, F.lit(12)), F.pmod(F.get(t, 2) - root, F.lit(12))
    quality = F.when(third == 4, F.when(fifth == 8, "+").otherwise("")).otherwise(F.when(fifth == 7, "m").otherwise("°"))
    return F.when(F.size(p) > 0, F.concat(pitch_name(root), quality))


def pitch_class(name) -> Column:
    """Letter and accidentals, wrapped to 0..11; unknown letters are null."""
    n = _col(name)
    letter = F.upper(F.substring(n, 1, 1))
    base = F.lit(None).cast("int")
    for k, v in LETTERS.items():
        base = F.when(letter == k, F.lit(v)).otherwise(base)
    accidental = F.regexp_extract(n, "^[A-Ga-g]([#b]*)", 1)
    sharps = F.length(F.regexp_replace(accidental, "b", "")) - F.length(F.regexp_replace(accidental, "#", ""))
    return F.pmod(base + sharps, F.lit(12)).cast("int")


def triad_quality(label) -> Column:
    """maj, min, aug or dim, by what follows the root."""
    rest = F.regexp_replace(_col(label), "^[A-Ga-g][#b]*", "")
    return (
        F.when(rest.rlike(r"^(\+|aug)"), "aug").when(rest.rlike("^(°|o|dim)"), "dim").when(rest.rlike("^(m(?!aj)|-)"), "min").otherwise("maj")
    )


def label_to_pc_set(label, sevenths: bool = False) -> Column:
    """Root, third and fifth (always seven up), and the seventh if asked for."""
    root, quality = pitch_class(label), triad_quality(label)
    third = F.when(quality == "min", 3).otherwise(4)
    parts = [F.lit(0), third, F.lit(7)]
    if sevenths:
        parts.append(F.when(quality == "maj", 11).otherwise(10))
    return F.array_sort(F.transform(F.array(*parts), lambda x: F.pmod(x + root, F.lit(12)).cast("int")))


def fold_difference(d) -> Column:
    """A difference of pitch classes, folded to -6..6."""
    x = F.pmod(_col(d), F.lit(12))
    return F.when(x > 6, x - 12).otherwise(x).cast("int")


def key_difference(root1, mode1, root2, mode2) -> Column:
    """Semitones between keys; 0 for equal, parallel and relative keys. Modes are
    'major' and 'minor'; keys of different modes compare by the relative major."""
    r1, m1, r2, m2 = map(_col, (root1, mode1, root2, mode2))
    major1, major2 = F.when(m1 == "minor", r1 + 3).otherwise(r1), F.when(m2 == "minor", r2 + 3).otherwise(r2)
    same = (r1 == r2) | (F.pmod(major1 - major2, F.lit(12)) == 0)
    return F.when(same, 0).when(m1 == m2, fold_difference(r2 - r1)).otherwise(fold_difference(major2 - major1)).cast("int")


def tuning_ratio(key_diff, target, current) -> Column:
    """2 ** (difference / 12) * target / current; differences beyond 3 count as none."""
    d = _col(key_diff)
    d = F.when(F.abs(d) > 3, 0).otherwise(d)
    return F.pow(F.lit(2.0), d / 12) * _col(target) / _col(current)
