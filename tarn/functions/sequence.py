"""Sequences: translation, assembly, alignment scores, numbering."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

_BASES = "TCAG"
#: The standard genetic code, codons in the order of the bases T, C, A, G.
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODE = {a + b + c: _AMINO[16 * i + 4 * j + k] for i, a in enumerate(_BASES) for j, b in enumerate(_BASES) for k, c in enumerate(_BASES)}
#: One-letter codes of the residues.
ONE_LETTER = dict(zip("ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL".split(), "ARNDCQEGHILKMFPSTWYV", strict=True))
_ORDER = "ARNDCQEGHILKMFPSTWYV"
#: The lower triangle of BLOSUM62 in that order, a row a line.
_BLOSUM62 = """4
-1 5
-2 0 6
-2 -2 1 6
0 -3 -3 -3 9
-1 1 0 0 -3 5
-1 0 0 2 -4 2 5
0 -2 0 -1 -3 -2 -2 6
-2 0 1 -1 -3 0 0 -2 8
-1 -3 -3 -3 -1 -3 -3 -4 -3 4
-1 -2 -3 -4 -1 -2 -3 -4 -3 2 4
-1 2 0 -1 -3 1 1 -2 -1 -3 -2 5
-1 -1 -2 -3 -1 0 -2 -3 -2 1 2 -1 5
-2 -3 -3 -3 -2 -3 -3 -3 -1 0 0 -3 0 6
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4 7
1 -1 1 0 -1 0 0 0 -1 -2 -2 0 -1 -2 -1 4
0 -1 0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1 1 5
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1 1 -4 -3 -2 11
-2 -2 -2 -3 -2 -1 -2 -3 2 -1 -1 -2 -1 3 -3 -2 -2 2 7
0 -3 -3 -3 -1 -2 -2 -3 -3 3 1 -2 1 -1 -2 -2 0 -3 -1 4"""
_ROWS = [[int(x) for x in line.split()] for line in _BLOSUM62.split("\n")]
BLOSUM62 = {(a, b): _ROWS[max(i, j)][min(i, j)] for i, a in enumerate(_ORDER) for j, b in enumerate(_ORDER)}


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def translate(nt: Column) -> Column:
    """Amino acids of a nucleotide text: gaps ``-`` and ``.`` go first, an unknown codon is X, a partial one is dropped."""
    table = literal_map(CODE)

    def codons(s: Column) -> Column:
        starts = F.when(F.length(s) >= 3, F.sequence(F.lit(1), F.length(s) - 2, F.lit(3))).otherwise(F.array().cast("array<int>"))
        return F.array_join(F.transform(starts, lambda i: F.coalesce(F.try_element_at(table, F.substr(s, i, F.lit(3))), F.lit("X"))), "")

    # the cleaned text is bound once, not computed anew for every codon
    return F.transform(F.array(F.upper(F.regexp_replace(nt, r"[.\-]", ""))), codons)[0]


def stem(gene: Column) -> Column:
    """A gene without its allele and a trailing D."""
    return F.regexp_replace(F.split_part(gene, F.lit("*"), F.lit(1)), "D$", "")


def lane(barcode: Column) -> Column:
    return F.element_at(F.split(barcode, "-"), -1).try_cast("int")


def nth_field(name: Column, separator: str, n: int) -> Column:
    return F.split_part(name, F.lit(separator), F.lit(n))


def short_tag(*parts: Column, digits: int = 10) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, digits)


def region(position: Column) -> Column:
    """Loop of an IMGT number, else framework. The bounds are fixed values of that numbering."""
    loops = {"CDR1": (27, 38), "CDR2": (56, 65), "HV4": (81, 86), "CDR3": (105, 117)}
    out = F.lit("FW")
    for name, (a, b) in loops.items():
        out = F.when(position.between(a, b), name).otherwise(out)
    return out


def assemble(segments: list[Column], *fallbacks: Column) -> Column:
    """The segments joined if all are there and look like amino acids (not nucleotides alone), else the first fallback."""
    whole = F.concat(*segments)
    return F.coalesce(F.when(~F.upper(whole).rlike("^[ACGTN]*$"), whole), *fallbacks)


def splice(v: Column, junction: Column, j: Column, v_to: int = 103, j_from: int = 10) -> Column:
    """Reference V up to ``v_to``, the junction, and J from its ``j_from``-th symbol."""
    return F.concat(F.substring(v, 1, v_to), junction, F.substr(j, F.lit(j_from), F.length(j)))


def origin(at: Column, n_v: Column, n_j: Column, length: Column) -> Column:
    """V, J or junction for the place ``at`` (from 1) of a junction of ``length``; null where an extent isn't known."""
    return F.when(n_v.isNull() | n_j.isNull(), None).when(at <= n_v, "V").when(at > length - n_j, "J").otherwise("junction")


def global_score(a: str, b: str, gap_open: float = -10.0, gap_extend: float = -1.0) -> float:
    """Needleman-Wunsch-Gotoh with BLOSUM62; a gap of n costs open + (n - 1) extend."""
    n, m = len(a), len(b)
    best = np.full((n + 1, m + 1), -np.inf)
    in_a, in_b = best.copy(), best.copy()
    best[0, 0] = 0.0
    for i in range(1, n + 1):
        in_b[i, 0] = gap_open + (i - 1) * gap_extend
        best[i, 0] = in_b[i, 0]
    for j in range(1, m + 1):
        in_a[0, j] = gap_open + (j - 1) * gap_extend
        best[0, j] = in_a[0, j]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            in_a[i, j] = max(best[i, j - 1] + gap_open, in_a[i, j - 1] + gap_extend)
            in_b[i, j] = max(best[i - 1, j] + gap_open, in_b[i - 1, j] + gap_extend)
            best[i, j] = max(best[i - 1, j - 1] + BLOSUM62.get((a[i - 1], b[j - 1]), 0), in_a[i, j], in_b[i, j])
    return float(best[n, m])


@F.pandas_udf(DoubleType())
def alignment_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - s(a, b) / sqrt(s(a, a) s(b, b)); null for a null or empty sequence. Score each distinct pair once and join back."""
    own: dict = {}

    def self_score(x: str) -> float:
        return own[x] if x in own else own.setdefault(x, sum(BLOSUM62.get((c, c), 0) for c in x))

    return pd.Series([1 - global_score(x, y) / np.sqrt(self_score(x) * self_score(y)) if x and y and self_score(x) > 0 and self_score(y) > 0 else None for x, y in zip(a, b, strict=True)], dtype=float)


#: Fixed values of the residues: side-chain volume, formal charge, hydrogen-bond donors and acceptors, hydropathy.
PROPERTIES = {
    "ALA": (88.6, 0, 0, 0, 1.8),
    "ARG": (173.4, 1, 3, 0, -4.5),
    "ASN": (114.1, 0, 1, 1, -3.5),
    "ASP": (111.1, -1, 0, 2, -3.5),
    "CYS": (108.5, 0, 1, 0, 2.5),
    "GLN": (143.8, 0, 1, 1, -3.5),
    "GLU": (138.4, -1, 0, 2, -3.5),
    "GLY": (60.1, 0, 0, 0, -0.4),
    "HIS": (153.2, 0.1, 1, 1, -3.2),
    "ILE": (166.7, 0, 0, 0, 4.5),
    "LEU": (166.7, 0, 0, 0, 3.8),
    "LYS": (168.6, 1, 1, 0, -3.9),
    "MET": (162.9, 0, 0, 0, 1.9),
    "PHE": (189.9, 0, 0, 0, 2.8),
    "PRO": (112.7, 0, 0, 0, -1.6),
    "SER": (89.0, 0, 1, 1, -0.8),
    "THR": (116.1, 0, 1, 1, -0.7),
    "TRP": (227.8, 0, 1, 0, -0.9),
    "TYR": (193.6, 0, 1, 1, -1.3),
    "VAL": (140.0, 0, 0, 0, 4.2),
}
PROPERTY_NAMES = ["volume", "charge", "donors", "acceptors", "hydropathy"]
#: Residues of a shape's channels; all residues are a channel too, and the hydrophobic ones have a positive hydropathy.
CHARGED = {"positive": ["LYS", "ARG", "HIS"], "negative": ["ASP", "GLU"], "polar": ["SER", "THR", "ASN", "GLN", "TYR", "HIS", "TRP"]}


def shape_channels() -> list[tuple[str, str]]:
    """(residue, channel) of the five channels."""
    own = [(r, c) for r in PROPERTIES for c in ("all", *(["hydrophobic"] if PROPERTIES[r][4] > 0 else []))]
    return own + [(r, c) for c, rs in CHARGED.items() for r in rs]


#: Fixed values of the paired sequence distance: cost of a gap's symbol, weight of the junction, and the trims at its ends.
GAP, JUNCTION_WEIGHT, TRIM_START, TRIM_END = 4, 3, 3, 2
#: Symbols on either side of a junction's gap, and the first and last place of a gap elsewhere.
EDGE, FIRST_GAP, LAST_GAP = 5, 3, 6


def substitution_cost(x: str, y: str) -> int:
    """0 for equal or unknown symbols, else 4 less the BLOSUM62 score, which counts from 0: between 1 and 4."""
    if x == y or (x, y) not in BLOSUM62:
        return 0
    return min(4, 4 - max(0, BLOSUM62[x, y]))


def loop_distance(a: str, b: str, junction: bool) -> int:
    """Cost of two loops. Of unequal ones the shorter is split at a gap: a fixed place, or the best one in a junction.

    Running costs of the places before a gap, lined up at the start, and of those behind it, lined up at the end, give the
    cost of every place of the gap in one pass.
    """
    front, back, weight = (TRIM_START, TRIM_END, JUNCTION_WEIGHT) if junction else (0, 0, 1)
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    s, extra = len(short), abs(len(a) - len(b))
    counts = np.arange(s)
    from_start = np.array([substitution_cost(x, y) for x, y in zip(short, long, strict=False)], int) * (counts >= front)
    if not extra:
        return weight * int(from_start[: max(0, s - back)].sum())
    from_end = np.array([substitution_cost(x, y) for x, y in zip(short, long[extra:], strict=True)], int) * (counts < s - back)
    cost = np.concatenate([[0], from_start.cumsum()]) + np.concatenate([from_end[::-1].cumsum()[::-1], [0]])
    if junction:
        spare = max(0, EDGE - s // 2)  # a loop too short for the margins gets as much less of them on either side
        places = cost[max(0, EDGE - spare) : s - EDGE + spare + 1]
    else:
        places = cost[[max(0, min(LAST_GAP, FIRST_GAP + (s - EDGE) // 2))]]
    return weight * (int(places.min()) + GAP * extra)


@F.pandas_udf(LongType())
def junction_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([loop_distance(x, y, True) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def germline_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([loop_distance(x, y, False) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="Int64")
