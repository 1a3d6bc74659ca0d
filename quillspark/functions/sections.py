"""Markdown headings: the section table of a document, titles, breadcrumbs, anchors.

Everything works on one row's text with array expressions, so a document table
of any size is processed without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let, offsets
from .text import rstrip, slugify, strip


def heading_text(rest: Column) -> Column:
    """Text of an ATX heading: the line after its opening marks, without a closing run of ``#``.

    A line that is nothing but closing marks keeps its first one.
    """
    bare = F.rtrim(F.rtrim(rstrip(rest), F.lit("#")), F.lit(" \t"))
    return F.coalesce(F.nullif(strip(bare), F.lit("")), strip(F.substring(rest, 1, 1)))


def parse_sections(body: Column | str) -> Column:
    """Headings as ``array<struct<level,text,char_offset,anchor>>`` in document order.

    A repeated slug gets ``-1``, ``-2`` …; the counter belongs to the plain slug,
    so a heading whose own text ends in a number may still collide with it. A
    heading without slug characters is named ``section-<n>`` after its position.
    """
    text = F.col(body) if isinstance(body, str) else body

    def headings(parts: Column) -> Column:
        # Every part but perhaps the first starts at a heading line.
        starts = offsets(F.transform(parts, lambda part: F.length(part) + 1))
        marked = F.filter(
            F.transform(
                F.arrays_zip(parts.alias("part"), starts.alias("start")),
                lambda z: F.struct(F.regexp_extract(z["part"], r"^[^\n]*", 0).alias("line"),
                                   z["start"].alias("start")),
            ),
            lambda z: z["line"].rlike(r"^#{1,6}[ \t]"),
        )
        read = F.transform(
            marked,
            lambda z: F.struct(
                F.length(F.regexp_extract(z["line"], r"^#{1,6}", 0)).alias("level"),
                heading_text(F.regexp_replace(z["line"], r"^#{1,6}[ \t]+", "")).alias("text"),
                z["start"].cast("int").alias("char_offset"),
            ),
        )
        return F.transform(
            F.filter(read, lambda h: h["text"] != ""),
            lambda h, i: F.struct(
                h["level"].alias("level"), h["text"].alias("text"), h["char_offset"].alias("char_offset"),
                F.coalesce(
                    F.nullif(slugify(h["text"]), F.lit("")),
                    F.concat(F.lit("section-"), (i + 1).cast("string")),
                ).alias("base"),
            ),
        )

    heads = let(F.split(text, r"\n(?=#{1,6}[ \t])"), headings)
    seed = F.struct(
        F.array().cast("array<struct<level:int,text:string,char_offset:int,anchor:string>>").alias("out"),
        F.create_map().cast("map<string,int>").alias("seen"),
    )

    def step(acc: Column, head: Column) -> Column:
        def add(count: Column) -> Column:
            anchor = F.when(count == 0, head["base"]).otherwise(
                F.concat(head["base"], F.lit("-"), count.cast("string"))
            )
            entry = F.struct(
                head["level"].alias("level"), head["text"].alias("text"),
                head["char_offset"].alias("char_offset"), anchor.alias("anchor"),
            )
            others = F.map_filter(acc["seen"], lambda k, v: k != head["base"])
            return F.struct(
                F.concat(acc["out"], F.array(entry)).alias("out"),
                F.map_concat(others, F.create_map(head["base"], count + 1)).alias("seen"),
            )

        return let(F.coalesce(F.try_element_at(acc["seen"], head["base"]), F.lit(0)), add)

    return F.aggregate(heads, seed, step, lambda acc: acc["out"])


def section_title(sections: Column | str) -> Column:
    """First level-1 heading, else the first heading, else null."""
    secs = F.col(sections) if isinstance(sections, str) else sections
    tops = F.filter(secs, lambda s: s["level"] == 1)
    return F.coalesce(F.try_element_at(tops, F.lit(1))["text"], F.try_element_at(secs, F.lit(1))["text"])


def breadcrumbs(headings: Column) -> Column:
    """For each ``struct<level,text>`` the headings that enclose it, itself last."""
    seed = F.struct(
        F.array().cast("array<array<string>>").alias("out"),
        F.array().cast("array<struct<level:int,text:string>>").alias("open"),
    )

    def step(acc: Column, head: Column) -> Column:
        kept = F.filter(acc["open"], lambda h: h["level"] < head["level"])
        here = F.struct(head["level"].cast("int").alias("level"), head["text"].alias("text"))
        return let(
            F.concat(kept, F.array(here)),
            lambda opened: F.struct(
                F.concat(acc["out"], F.array(F.transform(opened, lambda h: h["text"]))).alias("out"),
                opened.alias("open"),
            ),
        )

    return F.aggregate(headings, seed, step, lambda acc: acc["out"])


def with_anchors(chunks: Column, spans: Column, sections: Column) -> Column:
    """``array<struct<c,s,anchor>>`` of chunks, their spans and the anchor of each chunk's innermost section.

    Done on the array, so that a document's sections are not copied onto every chunk row.
    """
    return F.transform(F.arrays_zip(chunks.alias("c"), spans.alias("s")), lambda z: F.struct(
        z["c"].alias("c"), z["s"].alias("s"),
        F.when(F.size(z["c"]["section_path"]) > 0, anchor_for(F.try_element_at(z["c"]["section_path"], F.lit(-1)), sections)).alias("anchor"),
    ))


def anchor_for(heading: Column, sections: Column) -> Column:
    """Anchor of the last section with this text, else the slug of the text, else null."""
    same = F.filter(sections, lambda s: s["text"] == heading)
    found = F.try_element_at(same, F.lit(-1))["anchor"]
    return F.coalesce(found, F.nullif(slugify(heading), F.lit("")))
