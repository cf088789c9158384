"""Spans of patterns in a text as column expressions: kind, start and end in code points, end exclusive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegrain.llm.common import let

#: Matches are placed chunk by chunk, so that a text with very many of them costs no quadratic time.
_CHUNK = 256


def matches(text: Column, pattern: str, group: int = 0, guard: Column | None = None, keep: Callable[[Column, Column], Column] | None = None) -> Column:
    """array<struct<start long, end long, text string, part string>>: the leftmost matches that do not overlap.

    `part` is the group's text. `guard` is a cheap condition without which no match is looked for; `keep` filters
    by (text, part).
    """
    pieces = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    none = F.array().cast("array<struct<start:bigint,end:bigint,text:string,part:string>>")

    def placed(found: Column) -> Column:
        def chunk(c: Column) -> Column:
            own = F.slice(found["rows"], c * _CHUNK + 1, F.lit(_CHUNK))
            begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))

            def step(acc: Column, x: Column) -> Column:
                start = acc["at"] + F.length(x["gap"])
                end = start + F.length(x["text"])
                one = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["part"].alias("part"))
                return F.struct(end.alias("at"), F.array_append(acc["out"], one).alias("out"))

            return F.aggregate(own, begin, step)

        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found["rows"]) - 1) / _CHUNK).cast("int")), chunk)
        return let(chunks, _joined)

    def rows(found: Column) -> Column:
        return F.arrays_zip(F.slice(found["pieces"], 1, F.size(found["whole"])).alias("gap"), found["whole"].alias("text"), found["part"].alias("part"))

    def placed_or_none(found: Column) -> Column:
        return F.when(F.size(found["whole"]) == 0, none).otherwise(let(F.struct(rows(found).alias("rows")), placed))

    raw = F.when(F.size(whole) > 0, let(F.struct(pieces.alias("pieces"), whole.alias("whole"), part.alias("part")), placed_or_none)).otherwise(none)
    if guard is not None:
        raw = F.when(guard, raw).otherwise(none)
    return raw if keep is None else F.filter(raw, lambda m: keep(m["text"], m["part"]))


def _joined(chunks: Column) -> Column:
    """Chunks of spans, each counted from its own beginning, in one list counted from the text's."""
    ends = F.aggregate(chunks, F.array(F.lit(0).cast("long")), lambda acc, c: F.array_append(acc, F.element_at(acc, -1) + c["at"]))

    def shifted(base: Column) -> Column:
        return F.flatten(
            F.transform(
                chunks,
                lambda c, i: F.transform(
                    c["out"],
                    lambda m: F.struct(
                        (m["start"] + F.get(base, i)).alias("start"), (m["end"] + F.get(base, i)).alias("end"), m["text"].alias("text"), m["part"].alias("part")
                    ),
                ),
            )
        )

    return let(ends, shifted)


def listed(spans: Column) -> Column:
    """kind:start:end of spans (start, rank, kind, end, ...), by start and then rank, joined by commas."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def ranked(spans: Column, kind: str, rank: int) -> Column:
    """The spans as struct<start, end, rank, kind>."""
    return F.transform(spans, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind")))
