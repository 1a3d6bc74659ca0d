"""Cut documents into chunks.

``line_chunks`` makes one chunk per non-blank line. ``chunk_documents`` makes
token-bounded chunks that never cross a heading. Both work row by row on array
expressions: a document's chunks are computed where its text is read, and the
dense ``chunk_index`` is the array position, so no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.sections import breadcrumbs, parse_sections, with_anchors
from ..functions.text import TOKEN_RE, is_blank, strip, token_count

MAX_TOKENS = 512
MIN_PROBE = 12

_LINE_BREAK = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x85\\u2028\\u2029]"
_OTHER_BREAK = "[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
_BLANK_END = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000](?:\n|\z)"
_TRAILING = r"[ \t\x1f\xa0\u1680\u2000-\u200a\u202f\u205f\u3000]+(?=\n|\z)"


def line_chunks(docs: DataFrame, id_col: str = "document_id", text_col: str = "body",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """One chunk per non-blank line, numbered from 0 within its document."""
    lines = F.filter(F.transform(F.split(text_col, "\n"), strip), lambda line: line != "")
    return docs.select(id_col, *keep, F.posexplode(lines).alias("chunk_index", "content")).select(
        F.concat_ws("-", F.col(id_col).cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col(id_col).cast("string").alias("document_id"),
        *keep, "chunk_index", "content",
    )


def section_parts(body: Column, sections: Column) -> Column:
    """Body as ``array<struct<level,heading,paragraphs>>``, one entry per heading.

    The first entry holds the text before any heading (level 0). A line counts
    as a heading only when it starts with ``#`` and its text, stripped on the
    left, is a parsed section; other ``#`` lines stay paragraph text.
    """

    # One line break, no blanks before it, whatever the source used.
    # Most texts need neither step, and looking is much cheaper than replacing.
    lines = let(
        F.when(body.rlike(_OTHER_BREAK), F.regexp_replace(body, _LINE_BREAK, "\n")).otherwise(body),
        lambda t: F.when(t.rlike(_BLANK_END), F.regexp_replace(t, _TRAILING, "")).otherwise(t),
    )

    texts = F.transform(sections, lambda s: s["text"])

    def read(part: Column, i: Column) -> Column:
        line = F.regexp_extract(part, r"^[^\n]*", 0)
        return let(strip(F.ltrim(line, F.lit("# "))), lambda bare: F.struct(
            F.when(line.startswith("#") & F.array_contains(texts, bare), i).alias("at"),
            F.least(F.length(F.regexp_extract(line, "^#+", 0)), F.lit(6)).alias("level"),
            bare.alias("heading"),
            F.substring(part, F.length(line) + 2, F.length(part)).alias("rest"),
            part.alias("whole"),
        ))

    def paragraphs(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda p: p != "").alias("paragraphs")

    def gather(parts: Column) -> Column:
        def under(start: Column, end: Column) -> Column:
            """The parts from ``start`` (counted from 0) up to ``end`` as one text."""
            return F.array_join(F.transform(F.slice(parts, start + 1, end - start), lambda p: p["whole"]), "\n")

        def of_heads(heads: Column) -> Column:
            ends = F.concat(F.transform(heads, lambda h: h["at"]), F.array(F.size(parts)))
            lead = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("heading"),
                            paragraphs(under(F.lit(0), F.element_at(ends, 1))))
            rest = F.transform(heads, lambda h, j: F.struct(
                h["level"].alias("level"), h["heading"].alias("heading"),
                paragraphs(F.concat_ws("\n", h["rest"], under(h["at"] + 1, F.get(ends, j + 1)))),
            ))
            return F.concat(F.array(lead), rest)

        return let(F.filter(parts, lambda p: p["at"].isNotNull()), of_heads)

    # Only a line that starts with `#` can be a heading, so the text is cut there.
    return let(F.transform(F.split(lines, r"\n(?=#)"), read), gather)


def _split_long(paragraph: Column, budget: Column, token_re: str) -> Column:
    """A paragraph as pieces of at most ``budget`` tokens; nothing but edge blanks is lost."""
    spaced = F.regexp_extract_all(paragraph, F.lit(rf"\s*(?:{token_re})"), F.lit(0))

    def cut(tokens: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(tokens) - 1) / budget).cast("int")),
            lambda i: F.struct(
                strip(F.array_join(F.slice(tokens, (i * budget + 1).cast("int"), budget.cast("int")), "")).alias("text"),
                F.least(budget, F.size(tokens) - i * budget).cast("int").alias("n"),
            ),
        )
        whole = F.array(F.struct(paragraph.alias("text"), F.size(tokens).cast("int").alias("n")))
        return F.when(F.size(tokens) <= budget, whole).otherwise(pieces)

    return let(spaced, cut)


def _pack(pieces: Column, budget: Column) -> Column:
    """Greedy, order-preserving merge of neighbours while they fit the budget."""
    seed = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.lit(None).cast("string").alias("open"),
        F.lit(0).alias("n"),
    )
    return F.aggregate(
        pieces, seed,
        lambda s, p: F.when(
            s["open"].isNull() | (s["n"] + p["n"] <= budget),
            F.struct(
                s["done"].alias("done"),
                F.concat_ws("\n", s["open"], p["text"]).alias("open"),
                (s["n"] + p["n"]).alias("n"),
            ),
        ).otherwise(
            F.struct(F.concat(s["done"], F.array(s["open"])).alias("done"),
                     p["text"].alias("open"), p["n"].alias("n"))
        ),
        lambda s: F.when(s["open"].isNull(), s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))),
    )


def has_paragraphs(parts: Column) -> Column:
    """Whether a document gives any chunk at all: headings alone give none."""
    return F.coalesce(F.exists(parts, lambda p: F.size(p["paragraphs"]) > 0), F.lit(False))


def chunk_contents(parts: Column, max_tokens: int, token_re: str, keep_headings: bool = False) -> Column:
    """``array<struct<content,section_path>>`` of one document from its ``section_parts``.

    The headings above a chunk stand in front of its text and count towards the
    limit; when they alone take more than half of it they are left out of the
    content and kept in ``section_path`` only, or with ``keep_headings`` stand once, in
    pieces where needed, before the section's first text.
    """

    def with_paths(parts: Column) -> Column:
        heads = F.filter(parts, lambda p: p["level"] > 0)
        paths = breadcrumbs(F.transform(heads, lambda p: F.struct(p["level"].alias("level"), p["heading"].alias("text"))))
        # Only the first part can lack a heading; shift the paths past it.
        lead = F.when(F.element_at(parts, 1)["level"] > 0, F.array().cast("array<array<string>>")).otherwise(
            F.array(F.array().cast("array<string>"))
        )
        return F.arrays_zip(parts.alias("part"), F.concat(lead, paths).alias("path"))

    def chunks(zipped: Column) -> Column:
        def one(z: Column) -> Column:
            return let(
                token_count(F.array_join(z["path"], "\n"), token_re),
                lambda used: let(
                    F.when(used > max_tokens // 2, F.lit(0)).otherwise(used),
                    lambda shown: F.transform(
                        _pack(
                            F.flatten(F.transform(
                                F.when(F.lit(keep_headings) & (used > shown), F.concat(z["path"], z["part"]["paragraphs"])).otherwise(z["part"]["paragraphs"]),
                                lambda p: _split_long(p, F.lit(max_tokens) - shown, token_re),
                            )),
                            F.lit(max_tokens) - shown,
                        ),
                        lambda text: F.struct(
                            F.when(shown > 0, F.concat(F.array_join(z["path"], "\n"), F.lit("\n"), text))
                            .otherwise(text).alias("content"),
                            z["path"].alias("section_path"),
                        ),
                    ),
                ),
            )

        return F.flatten(F.transform(F.filter(zipped, lambda z: F.size(z["part"]["paragraphs"]) > 0), one))

    return let(let(parts, with_paths), chunks)


def locate_chunks(contents: Column, body: Column) -> Column:
    """Character spans of chunks in the body, found by a cursor that moves forward.

    Tried in order: the exact text after the cursor, the exact text anywhere, the
    first line (12 characters at least) after the cursor, the cursor itself.
    """
    seed = F.struct(
        F.array().cast("array<struct<char_start:int,char_end:int>>").alias("out"), F.lit(0).alias("cursor")
    )

    def find(text: Column, start: Column) -> Column:
        # Past the end of the body there is nothing to find; locate() answers 0.
        return F.nullif(F.call_function("locate", text, body, (start + 1).cast("int")), F.lit(0)) - 1

    def step(acc: Column, content: Column) -> Column:
        first = F.element_at(F.filter(F.split(content, "\n"), lambda line: ~is_blank(line)), 1)
        probe = F.when(F.length(first) >= MIN_PROBE, find(first, acc["cursor"]))
        hit = F.coalesce(find(content, acc["cursor"]), find(content, F.lit(0)), probe)
        size = F.length(content)
        return let(
            F.struct(hit.alias("hit"), size.alias("size")),
            lambda v: let(
                F.struct(
                    F.coalesce(v["hit"], acc["cursor"]).cast("int").alias("char_start"),
                    F.when(v["hit"].isNotNull(), v["hit"] + v["size"])
                    .otherwise(F.least(acc["cursor"] + v["size"], F.length(body))).cast("int").alias("char_end"),
                ),
                lambda span: F.struct(
                    F.concat(acc["out"], F.array(span)).alias("out"), span["char_end"].alias("cursor")
                ),
            ),
        )

    return F.aggregate(contents, seed, step, lambda acc: acc["out"])


def chunk_documents(docs: DataFrame, max_tokens: int = MAX_TOKENS, token_re: str = TOKEN_RE,
                    keep: tuple[str, ...] = (), keep_headings: bool = False) -> DataFrame:
    """Chunks of ``docs(document_id, body, ...)``; blank bodies give none. ``keep_headings``: see ``chunk_contents``.

    Output: chunk_id, document_id, kept columns, content, chunk_index,
    section_path, anchor, char_start, char_end.
    """
    base = docs.where(~is_blank("body"))
    if "sections" not in docs.columns:
        base = base.withColumn("sections", parse_sections("body"))
    cut = base.withColumn("_parts", section_parts(F.col("body"), F.col("sections"))).withColumn(
        "_chunks", chunk_contents(F.col("_parts"), max_tokens, token_re, keep_headings)
    )
    spans = cut.withColumn("_spans", locate_chunks(F.transform("_chunks", lambda c: c["content"]), F.col("body")))
    rows = spans.select(
        "document_id", *keep,
        F.posexplode(with_anchors(F.col("_chunks"), F.col("_spans"), F.col("sections"))).alias("chunk_index", "z"),
    )
    return rows.select(
        F.concat_ws("-", F.col("document_id").cast("string"), F.col("chunk_index").cast("string")).alias("chunk_id"),
        F.col("document_id").cast("string").alias("document_id"),
        *keep,
        F.col("z.c.content").alias("content"),
        "chunk_index",
        F.col("z.c.section_path").alias("section_path"),
        F.col("z.anchor").alias("anchor"),
        F.col("z.s.char_start").alias("char_start"),
        F.col("z.s.char_end").alias("char_end"),
    )


def request_batches(items: DataFrame, group: str, order: str, text_col: str = "content",
                    max_items: int = 1024, max_tokens: int = 250_000, max_item_tokens: int = 8191,
                    token_re: str = TOKEN_RE) -> DataFrame:
    """Pack each group's texts, in order, into requests under an item and a token limit.

    ``items`` holds one row per group with an ordered ``array<string>`` in
    ``text_col``; ``order`` names the output position. Over-long texts are cut
    after their last allowed token.
    """
    from ..functions.text import truncate_tokens

    counted = items.withColumn(
        "_n", F.transform(text_col, lambda t: F.least(token_count(t, token_re), F.lit(max_item_tokens)))
    )
    seed = F.struct(
        F.array().cast("array<int>").alias("out"), F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).alias("tokens")
    )

    def step(acc: Column, n: Column) -> Column:
        full = (acc["n"] > 0) & ((acc["tokens"] + n > max_tokens) | (acc["n"] >= max_items))
        return let(
            full,
            lambda f: let(
                acc["batch"] + f.cast("int"),
                lambda b: F.struct(
                    F.concat(acc["out"], F.array(b)).alias("out"), b.alias("batch"),
                    F.when(f, F.lit(1)).otherwise(acc["n"] + 1).alias("n"),
                    F.when(f, n).otherwise(acc["tokens"] + n).alias("tokens"),
                ),
            ),
        )

    packed = counted.withColumn("_b", F.aggregate("_n", seed, step, lambda acc: acc["out"]))
    rows = packed.select(
        group,
        F.posexplode(F.arrays_zip(F.col(text_col).alias("t"), F.col("_n").alias("n"), F.col("_b").alias("b"))).alias(order, "z"),
    )
    return rows.select(
        group, order, F.col("z.b").alias("batch_id"), F.col("z.n").alias("tokens"),
        truncate_tokens(F.col("z.t"), max_item_tokens, token_re).alias("text"),
    )
