"""Column functions on sequences and hits; all stay in the JVM."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in the order T, C, A, G of each codon position; stop is _.
CODE = "FFLLSSSSYY__CC_WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


_FLIP = str.maketrans("ACGT", "TGCA")


def reverse_complement(seq: Column) -> Column:
    """Letters other than ACGT become N."""
    return F.reverse(F.translate(F.regexp_replace(seq, "[^ACGT]", "N"), "ACGT", "TGCA"))


def translate_frame(seq: Column, frame: int) -> Column:
    """Amino acids of one reading frame (0, 1 or 2); a codon with another letter than ACGT is ?."""
    codons = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), CODE, strict=True)}
    table = F.create_map(*[F.lit(x) for kv in codons.items() for x in kv])
    return F.array_join(F.transform(F.regexp_extract_all(F.substr(seq, F.lit(frame + 1)), F.lit("(?s)(...)"), F.lit(1)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("?"))), "")


def six_frames(seq: Column) -> Column:
    """Amino acids of the frames 0, 1, 2 of the sequence and of its reverse complement."""
    return F.array(*[translate_frame(s, f) for s in (seq, reverse_complement(seq)) for f in range(3)])


def hit_score(length: Column, least: int = 23, adjust: int = 15) -> Column:
    return F.when(length < least, F.lit(0)).otherwise((length - adjust) * (length - adjust)).cast("long")


def assignment_weight(hit_length: Column, read_length: Column) -> Column:
    """1 while at most 1 % of the read is unmatched, then a quarter for each base more, at most 11 of them."""
    free = F.floor(read_length * 0.01).cast("int")
    over = read_length - hit_length - free
    return F.when(over < 0, F.lit(1.0)).otherwise(F.pow(F.lit(0.25), F.least(over, F.lit(11))))


def accession_number(name: Column) -> Column:
    return F.when(F.substring(name, 3, 1) == "_", F.nullif(F.regexp_extract(name, "([0-9]+)", 1), F.lit("")).try_cast("long"))


def base_name(path: Column) -> Column:
    """File name without directory, extension, and one sequence extension before it."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.[^.]*$", ""), r"\.(fna|fa|fasta|faa)$", "")


def size_of(text: str) -> int:
    """'12G' -> 12_000_000_000."""
    unit = {"K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}.get(text[-1:].upper())
    return int(text[:-1]) * unit if unit else int(text)


def least_hit_length(text_length: int, letters: int = 4, start: int = 23, most: int = 33) -> int:
    """The hit length below which chance hits are likely in a text of that length."""
    while start <= most and letters**start // 2 < 100 * text_length:
        start += 1
    return min(start, most)
