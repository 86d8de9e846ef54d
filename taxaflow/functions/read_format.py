"""Read formats: which bases of which record make up mate 1 (r1), mate 2 (r2), barcode (bc) and UMI (um).

A format is a list of part:start:end[:strand] separated by , or ;. Positions count from 0, the end is included, negative
ones count from the record's end. part:hd:field:start:end[:strand] takes them from the record's comment instead: the
numbered field between blanks, or the one that starts with a prefix. Segments are joined in the order written; with any
- strand the whole is reversed, bases are complemented too.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxaflow.functions.sequence import reverse_complement

PARTS = ("r1", "r2", "bc", "um")


@dataclass(frozen=True)
class Segment:
    start: int
    end: int
    back: bool = False
    field: str | None = None


def parse(text: str) -> dict[str, list[Segment]]:
    out: dict[str, list[Segment]] = {}
    for item in re.split("[,;]", text):
        words = item.split(":")
        part, words = words[0], words[1:]
        field = None
        if words[:1] == ["hd"]:
            field, words = (words[1:2] or [""])[0], words[2:]
            if not field:
                raise ValueError(f"no field in {item!r}")
        if part not in PARTS or len(words) not in (2, 3) or words[2:] not in ([], ["+"], ["-"]) or not all(re.fullmatch("-?[0-9]+", w) for w in words[:2]):
            raise ValueError(f"not a read format: {item!r}")
        out.setdefault(part, []).append(Segment(int(words[0]), int(words[1]), words[2:] == ["-"], field))
    return out


def _piece(source: Column, s: Segment) -> Column:
    n = F.length(source)
    start = F.greatest(n + s.start, F.lit(0)) if s.start < 0 else F.lit(s.start)
    end = n + s.end if s.end < 0 else F.least(F.lit(s.end), n - 1)
    return F.substring(source, start + 1, F.greatest(end - start + 1, F.lit(0)))


def _field(comment: Column, field: str) -> Column:
    text = F.coalesce(comment, F.lit(""))
    if field.isdigit():
        return F.coalesce(F.get(F.split(text, "[ \t]"), F.lit(int(field))), F.lit(""))
    return F.regexp_extract(text, f"({re.escape(field)}[^ \t]*)", 1)


def extract(segments: list[Segment], value: Column, comment: Column, bases: bool = True) -> Column:
    """The part as a column; bases = False for qualities, which are only reversed. A part that starts in the comment is taken from it whole."""
    if segments == [Segment(0, -1)]:
        return value
    where = [_field(comment, s.field or segments[0].field or "0") if segments[0].field is not None else value for s in segments]
    joined = F.concat(*[_piece(w, s) for w, s in zip(where, segments, strict=True)])
    if not any(s.back for s in segments):
        return joined
    return reverse_complement(joined) if bases else F.reverse(joined)
