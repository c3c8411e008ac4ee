"""Sequence expressions on string columns, all inside the JVM."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, bases in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def translate(dna: str | Column, frame: int = 0) -> Column:
    """Protein of a DNA string: gaps dropped, a rest of one or two bases dropped, codons with other letters are X."""
    s = F.substring(F.upper(F.regexp_replace(_col(dna), "-", "")), frame + 1, 2**30)
    code = F.create_map(*[F.lit(x) for codon, aa in zip(itertools.product(BASES, repeat=3), AMINO_ACIDS, strict=True) for x in ("".join(codon), aa)])
    codons = F.regexp_extract_all(s, F.lit(r"(?s).{3}"), F.lit(0))  # split once: a lambda would cut the text anew for each codon
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def reverse_complement(dna: str | Column) -> Column:
    return F.translate(F.reverse(_col(dna)), "ACGTacgtRYKMBVDHrykmbvdh", "TGCAtgcaYRMKVBHDyrmkvbhd")


def stop_positions(protein: str | Column) -> Column:
    """1-based places of ``*`` but for the last residue."""
    p = _col(protein)
    n = F.length(p)
    return F.filter(F.transform(F.split(p, ""), lambda c, i: F.when((c == "*") & (i < n - 1), i + 1)), lambda x: x.isNotNull())


def stop_status(protein: str | Column) -> Column:
    return F.when(F.size(stop_positions(protein)) > 0, "REMOVED").otherwise("OK")


def count_of(text: str | Column, chars: str) -> Column:
    return F.length(_col(text)) - F.length(F.regexp_replace(_col(text), f"[{chars}]", ""))


def n_content_ok(dna: str | Column, most: int = 9, share: float = 0.005) -> Column:
    """At most so many Ns, and at most such a share of the length, gaps included."""
    n = count_of(dna, "Nn")
    return (n <= most) & (n / F.length(_col(dna)) <= share)


def failures(protein: str | Column, least: int = 100) -> Column:
    """Array of reasons against a protein; a stop at its end is none."""
    p = F.regexp_replace(_col(protein), r"\*$", "")
    return F.array_compact(F.array(F.when(F.length(p) < least, "too_short"), F.when(p.contains("X"), "contains_X"), F.when(p.contains("*"), "internal_stop")))


def has_domains(protein: str | Column, cysteines: int = 6, motifs: tuple[str, ...] = ("G.G..G", "HRD[LIV]K")) -> Column:
    found = F.lit(False)
    for m in motifs:
        found = found | _col(protein).rlike(m)
    return (count_of(protein, "C") >= cysteines) & found


def p_distance(a: str | Column, b: str | Column, skip: str = "-", empty: float | None = None) -> Column:
    """Share of places that differ among those where neither has a character of ``skip``; ``empty`` where there is none."""
    pairs = F.filter(F.zip_with(F.split(_col(a), ""), F.split(_col(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & ~p["x"].isin(*skip) & ~p["y"].isin(*skip))
    differ = F.size(F.filter(pairs, lambda p: p["x"] != p["y"]))
    return F.when(F.size(pairs) > 0, differ / F.size(pairs)).otherwise(F.lit(empty).cast("double"))


def backfill_ends(row: str | Column, reference: str | Column, edge: int = 25) -> Column:
    """An aligned row whose gaps among the first and last ``edge`` columns get the reference's characters, further gaps at either end N; inner gaps stay. A row of gaps alone is null."""
    s = _col(row)
    n = F.length(s)
    first = F.length(F.regexp_extract(s, "^(-*)", 1))
    last = n - F.length(F.regexp_extract(s, "(-*)$", 1))

    def filled(x: Column) -> Column:
        pair = F.zip_with(F.split(x["s"], ""), F.split(x["ref"], ""), lambda c, r: F.struct(c.alias("c"), r.alias("r")))
        one = lambda p, i: F.when((p["c"] == "-") & ((i < edge) | (i >= x["n"] - edge)), p["r"]).when((p["c"] == "-") & ((i < x["first"]) | (i >= x["last"])), "N").otherwise(p["c"])
        return F.array_join(F.transform(F.slice(pair, 1, x["n"]), one), "")

    bound = F.struct(s.alias("s"), _col(reference).alias("ref"), n.alias("n"), first.alias("first"), last.alias("last"))
    return F.when(first < n, F.transform(F.array(bound), filled)[0])  # bound once for the row, not for each place


def masked(protein: str | Column, first: int, length: int) -> Column:
    """A range of a protein, X as a stop: the key by which haplotypes collapse."""
    return F.translate(F.substring(_col(protein), first, length), "X", "*")


def project_exons(row: str | Column, ranges: list[tuple[int, int]], reverse: bool = False) -> Column:
    """The columns of 1-based closed ranges of an aligned row, joined, gaps dropped."""
    out = F.regexp_replace(F.concat(*[F.substring(_col(row), a, b - a + 1) for a, b in ranges]), "-", "")
    return reverse_complement(out) if reverse else out


def column_map(reference_row: str) -> list[int]:
    """For each residue of an aligned reference (one row, on the driver) its 1-based column."""
    return [i + 1 for i, c in enumerate(reference_row) if c != "-"]


def length_between(seq: str | Column, least: int = 3250, most: int = 4000) -> Column:
    """Both bounds included."""
    return F.length(_col(seq)).between(least, most)


def region(protein: str | Column, first: int, last: int) -> Column:
    """Residues ``first`` to ``last`` (1-based, closed) of an aligned protein without gaps, X as a stop: the key by which haplotypes collapse to a range."""
    return F.translate(F.regexp_replace(F.substring(_col(protein), first, last - first + 1), "-", ""), "X", "*")


def translated_key(exon: str | Column, frame: int = 0) -> Column:
    """The protein of an exon up to its first stop: the key by which haplotypes collapse by translation; null where nothing is left."""
    p = F.substring_index(translate(exon, frame), "*", 1)
    return F.when(p != "", p)


def kmers(seq: str | Column, k: int = 11) -> Column:
    """The distinct words of k letters."""
    s = _col(seq)
    return F.when(F.length(s) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - k + 1), lambda i: F.substring(s, i, F.lit(k))))).otherwise(F.array().cast("array<string>"))


def oriented(seq: str | Column, reference: str | Column, k: int = 11) -> Column:
    """struct(seq, reversed): the strand that shares more words with the reference; as it is where both share as many."""
    s = _col(seq)
    ref = kmers(F.regexp_replace(_col(reference), "-", ""), k)
    back = reverse_complement(s)
    other = F.size(F.array_intersect(kmers(back, k), ref)) > F.size(F.array_intersect(kmers(s, k), ref))
    return F.when(other, F.struct(back.alias("seq"), F.lit(True).alias("reversed"))).otherwise(F.struct(s.alias("seq"), F.lit(False).alias("reversed")))


def padded(seq: str | Column, to: str | Column) -> Column:
    return F.rpad(_col(seq), _col(to), "-")
