"""Spans of regular expressions in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(pieces: Column, row: str, count: Column | None) -> Column:
    """Matches with their places, of type ``row``, from pieces (gap, match): one fold in blocks, so that what is
    copied on the way stays small beside the text. The last gap has no match."""

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        before = state["index"] + (F.regexp_count(x["gap"], count) if count is not None else 0)
        after = before + (F.regexp_count(x["match"], count) if count is not None else 0)
        place = F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), before.alias("index"), x["match"].alias("match")).cast(row)
        found = F.struct((start + F.length(x["match"])).cast("bigint").alias("at"), after.cast("bigint").alias("index"), F.concat(state["out"], F.array(place)).alias("out"))
        return F.when(x["match"].isNull(), state).otherwise(found)

    def block(state: Column, part: Column) -> Column:
        start = F.struct(state["at"].alias("at"), state["index"].alias("index"), F.array().cast(f"array<{row}>").alias("out"))
        return _let(F.aggregate(part, start, one), lambda d: F.struct(d["at"].alias("at"), d["index"].alias("index"), F.concat(state["out"], F.array(d["out"])).alias("out")))

    zero = F.lit(0).cast("bigint")
    first = F.struct(zero.alias("at"), zero.alias("index"), F.array().cast(f"array<array<{row}>>").alias("out"))
    parts = _let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda i: F.slice(p, i * BLOCK + 1, BLOCK)))
    return F.aggregate(parts, first, block, lambda state: F.flatten(state["out"]))


def spans(text: Column, pattern: Column, extra: Callable[[Column], dict[str, Column]], kinds: str, keep: Callable[[Column], Column] | None = None, count: Column | None = None) -> Column:
    """Array of structs (start, end, more) for the leftmost non-overlapping matches, in code points.

    ``extra`` gives further fields from the match, of the SQL types in ``kinds`` ("name type, ..."); matches
    that fail ``keep`` are dropped. With ``count``, a pattern, a field ``index`` counts its matches before
    the span. The text between matches is cut out by the same pattern, so starts are running sums. Either
    regular expression runs once over the text, and the sums are taken in blocks of matches.
    """
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, match: F.struct(gap.alias("gap"), match.alias("match")))
    placed = _running(pieces, "struct<start:bigint,end:bigint,index:bigint,match:string>", count)
    index = ["index bigint"] if count is not None else []
    row = "struct<" + ", ".join(f"{f.split()[0]}:{f.split(maxsplit=1)[1]}" for f in ["start bigint", "end bigint", *index, *filter(None, kinds.split(", "))]) + ">"

    def told(x: Column) -> Column:
        fields = {"start": x["start"], "end": x["end"], **({"index": x["index"]} if count is not None else {}), **extra(x["match"])}
        return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(row)

    return F.transform(placed if keep is None else F.filter(placed, lambda x: keep(x["match"])), told)


def none(kinds: str) -> Column:
    """An empty array of spans."""
    return F.array().cast(f"array<struct<{kinds}>>")
