"""String expressions: slugs, markers, shortening, decoding, report and citation text."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
CRUMB = " › "

# The marker an answer carries for each chunk it cites.
MARKER_RE = r"\[c:([A-Za-z0-9_-]+)\]"

# Phrases that mark an answer as a refusal; `{product}` is the
# name of the documented product, supplied by the deployment.
REFUSAL_PHRASES = (
    "the documentation library does not cover that topic",
    "the documentation library doesn't cover",
    "the documentation library does not cover",
    "documentation library doesn't contain",
    "documentation library does not contain",
    "not covered in the documentation",
    "not part of the documentation",
    "my search of the documentation didn't return",
    "my search of the documentation did not return",
    "search of the documentation didn't return",
    "search of the documentation did not return",
    "i couldn't find this in the documentation",
    "i could not find this in the documentation",
    "outside the scope of the {product} documentation",
    "i can only answer questions about the {product}",
    "can only answer questions about {product}",
    "don't have information about that in the documentation",
    "do not have information about that in the documentation",
)

# A run of up to 16 letters or digits, or one other visible character, is a token.
TOKEN_RE = r"[\p{L}\p{N}_]{1,16}|[^\p{L}\p{N}_\s]"
# Search terms: whole runs of letters and digits, after lower-casing.
TERM_RE = r"[\p{L}\p{N}]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Characters that count as whitespace at the ends of a text.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column | str) -> Column:
    """Remove whitespace (not only blanks) at both ends."""
    return F.trim(_col(c), F.lit(WHITESPACE))


def rstrip(c: Column | str) -> Column:
    return F.rtrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return F.coalesce(strip(c) == "", F.lit(True))


def slugify(c: Column | str) -> Column:
    """Lower-case, every run outside ``a-z0-9`` to one dash, no dash at the ends."""
    dashed = F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "-")
    return F.trim(dashed, F.lit("-"))


def strip_markers(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), MARKER_RE, "")


def cited_ids(c: Column | str) -> Column:
    """Distinct chunk ids named by the markers of a text, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(c), F.lit(MARKER_RE), F.lit(1)))


def token_count(c: Column | str, token_re: str = TOKEN_RE) -> Column:
    return F.size(F.regexp_extract_all(_col(c), F.lit(token_re), F.lit(0)))


def truncate_tokens(c: Column | str, max_tokens: int, token_re: str = TOKEN_RE) -> Column:
    """The text up to and including its ``max_tokens``-th token; shorter texts unchanged."""
    text = _col(c)
    spaced = F.regexp_extract_all(text, F.lit(rf"\s*(?:{token_re})"), F.lit(0))
    return F.when(F.size(spaced) <= max_tokens, text).otherwise(
        F.array_join(F.slice(spaced, 1, max_tokens), "")
    )


def terms(c: Column | str, term_re: str = TERM_RE) -> Column:
    """Search terms of a text, repeated as often as they occur."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(term_re), F.lit(0))


def shorten(c: Column | str, limit: int, keep: int, trim: bool = False) -> Column:
    """Texts longer than ``limit`` become their first ``keep`` characters and an ellipsis."""
    text = _col(c)
    head = F.substring(text, 1, keep)
    head = strip(head) if trim else head
    return F.when(F.length(text) > limit, F.concat(head, F.lit(ELLIPSIS))).otherwise(text)


def auto_title(current_title: Column | str, first_message: Column | str,
               default_title: str = "New Conversation") -> Column:
    """Title a conversation after its first user message while it has the default title."""
    msg = _col(first_message)
    made = F.when(F.length(msg) > 50, F.concat(strip(F.substring(msg, 1, 47)), F.lit(ELLIPSIS))).otherwise(strip(msg))
    return F.when((_col(current_title) == default_title) & msg.isNotNull(), made).otherwise(_col(current_title))


def collapse_space(c: Column | str) -> Column:
    return strip(F.regexp_replace(_col(c), r"\s+", " "))


def html_escape(c: Column | str) -> Column:
    out = _col(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def html_unescape(c: Column | str) -> Column:
    """Entities decoded in one pass, so nothing is decoded twice: numbers, and the names of HTML 4 and ``apos``.

    A non-breaking blank becomes a blank; an unknown name or a number that is no character stays.
    """
    text = _col(c)
    names = F.create_map(*[F.lit(x) for name, code in (*name2codepoint.items(), ("apos", 39)) for x in (name, " " if code == 160 else chr(code))])

    def decoded(piece: Column, i: Column) -> Column:
        name = F.regexp_extract(piece, r"^([A-Za-z][A-Za-z0-9]{1,30}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});", 1)
        digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substring(name, 3, 8), 16, 10)).otherwise(F.substring(name, 2, 8)).cast("int")
        known = digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        number = F.decode(F.unhex(F.lpad(F.hex(F.when(known, digits)), 8, "0")), "UTF-32")
        char = F.when(name.startswith("#"), F.when(digits == 160, " ").otherwise(number)).otherwise(F.try_element_at(names, name))
        after = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.when(i == 0, piece).when((name == "") | char.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(char, after))

    whole = F.array_join(F.transform(F.split(text, "&"), decoded), "")
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def is_refusal(c: Column | str, product: str = "product") -> Column:
    """True when the lower-cased text contains any refusal phrase."""
    low = F.lower(_col(c))
    found = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        found = found | F.contains(low, F.lit(phrase.format(product=product.lower())))
    return F.coalesce(found, F.lit(False))


def contains_folded(fields: list[Column | str], query: Column | str) -> Column:
    """Literal, case-folded search over the non-empty fields joined by a blank."""
    joined = F.concat_ws(" ", *[F.nullif(_col(f), F.lit("")) for f in fields])
    return F.contains(F.lower(joined), F.lower(strip(query)))


def strict_json(c: Column | str) -> Column:
    """The text as a variant when all of it is one JSON value, else null.

    The parser stops after the first value and ignores what follows, so the text
    is read as the first of exactly two array entries.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), _col(c), F.lit(",0]")))
    entries = F.try_variant_get(pair, "$", "array<variant>")
    return F.when(F.size(entries) == 2, F.get(entries, F.lit(0)))


# --- bytes to text ------------------------------------------------------------

# Content types that decide the format before any sniffing.
PDF_TYPES = ("application/pdf", "application/x-pdf")
MARKDOWN_TYPES = ("text/markdown", "text/x-markdown")
HTML_TYPES = ("text/html", "application/xhtml+xml")


def detect_format(content: Column | str, content_type: Column | str) -> Column:
    """``html``, ``pdf`` or ``markdown`` from the content type, else from how the content begins after any white space."""
    head = F.decode(_col(content), "ISO-8859-1")
    kind = F.lower(strip(F.split_part(_col(content_type), F.lit(";"), F.lit(1))))
    return (
        F.when(kind.isin(*PDF_TYPES), "pdf")
        .when(kind.isin(*MARKDOWN_TYPES), "markdown")
        .when(kind.isin(*HTML_TYPES), "html")
        .when(head.startswith("%PDF-"), "pdf")
        .when(head.rlike(r"^\s*<"), "html")
        .otherwise("markdown")
    )


def decode_html(content: Column | str) -> Column:
    """UTF-8 when the bytes are valid UTF-8, else Latin-1."""
    raw = _col(content)
    as_text = raw.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(raw, "ISO-8859-1"))


def decode_markdown(content: Column | str) -> Column:
    """UTF-8 with the replacement character for bytes that do not decode."""
    return F.make_valid_utf8(_col(content).cast("string"))


# Each step is (pattern, replacement), applied in order. Elements that are never
# content go first; then headings, list items and other blocks become lines.
HTML_STEPS = (
    (r"(?is)<!--.*?(?:-->|\z)", ""),
    (r"(?is)<script\b[^>]*>.*?(?:</script\s*>|\z)", ""),
    (r"(?is)<style\b[^>]*>.*?(?:</style\s*>|\z)", ""),
    (r"(?is)<head\b[^>]*>.*?</head\s*>", ""),
    (r"(?is)<nav\b[^>]*>.*?</nav\s*>", ""),
    (r"(?is)<header\b[^>]*>.*?</header\s*>", ""),
    (r"(?is)<footer\b[^>]*>.*?</footer\s*>", ""),
    (r"(?is)<aside\b[^>]*>.*?</aside\s*>", ""),
    (r'(?is)<div\s+class="(?:ad|ads|advert|cookie|banner)"[^>]*>.*?</div\s*>', ""),
    (r"\s+", " "),
    (r"(?i)<h1\b[^>]*>\s*", "\n\n# "),
    (r"(?i)<h2\b[^>]*>\s*", "\n\n## "),
    (r"(?i)<h3\b[^>]*>\s*", "\n\n### "),
    (r"(?i)<h4\b[^>]*>\s*", "\n\n#### "),
    (r"(?i)<h5\b[^>]*>\s*", "\n\n##### "),
    (r"(?i)<h6\b[^>]*>\s*", "\n\n###### "),
    (r"(?i)<li\b[^>]*>\s*", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?(?:p|div|article|section|main|body|ul|ol|table|blockquote|pre|h[1-6])\b[^>]*>", "\n\n"),
    (r"(?i)</?tr\b[^>]*>", "\n"),
    (r"(?i)</t[dh]\s*>", " | "),
    (r"<[^>]*>", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n[ \t]+", "\n"),
    (r"\n{3,}", "\n\n"),
)


CHROME_STEPS = 9  # the steps that take out what is never content
PRE_CUT = r"(?i)(?=<pre\b)|(?<=</pre>)"


def html_to_markdown(html: Column | str) -> Column:
    """Main-content markdown of a page: chrome removed, headings kept, entities decoded."""
    out = _col(html)
    for pattern, replacement in HTML_STEPS[:CHROME_STEPS]:
        out = F.regexp_replace(out, pattern, replacement)

    def flowing(part: Column) -> Column:
        for pattern, replacement in HTML_STEPS[CHROME_STEPS:]:
            part = F.regexp_replace(part, pattern, replacement)
        return html_unescape(part)

    def code(part: Column) -> Column:
        inner = F.regexp_replace(F.regexp_replace(part, r"(?i)<br\s*/?>", "\n"), r"<[^>]*>", "")
        return F.concat(F.lit("\n\n```\n"), F.regexp_replace(html_unescape(inner), r"^\n+|\s+$", ""), F.lit("\n```\n\n"))

    # Preformatted blocks keep their lines; all other text is cut at them and flows.
    parts = F.transform(F.split(out, PRE_CUT), lambda part: F.when(part.rlike(r"(?i)^<pre\b"), code(part)).otherwise(strip(flowing(part))))
    mixed = F.regexp_replace(F.array_join(parts, ""), r"(?<=```)\n{3,}(?=```\n)", "\n\n")
    return strip(F.when(out.rlike(r"(?i)<pre\b"), mixed).otherwise(flowing(out)))


def html_title(html: Column | str) -> Column:
    """Whitespace-collapsed ``<title>`` text, null when absent or blank."""
    raw = F.regexp_extract(_col(html), r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.nullif(collapse_space(raw), F.lit(""))


def html_lang(html: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(html), r'(?is)<html[^>]*\slang="([^"]*)"', 1), F.lit(""))


# --- report and export text -----------------------------------------------------


def report_title(question: Column | str, max_len: int = 80) -> Column:
    collapsed = collapse_space(F.coalesce(_col(question), F.lit("")))
    named = F.when(collapsed == "", F.lit("(no question)")).otherwise(collapsed)
    cut = F.concat(rstrip(F.substring(named, 1, max_len - 1)), F.lit(ELLIPSIS))
    return F.concat(F.lit("Answer feedback: "), F.when(F.length(named) > max_len, cut).otherwise(named))


def safe_fence(c: Column | str) -> Column:
    """A backtick fence longer than any run of backticks in the text, three at least."""
    runs = F.transform(F.regexp_extract_all(_col(c), F.lit("`+"), F.lit(0)), F.length)
    longest = F.coalesce(F.array_max(runs), F.lit(0))
    return F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))


def source_bullets(sources: Column | str) -> Column:
    """One bullet per citation: linked by url, else by vault path, else the bare title."""

    def bullet(src: Column) -> Column:
        title = F.coalesce(F.nullif(src["document_title"], F.lit("")), F.lit("(untitled)"))
        url = F.nullif(src["document_url"], F.lit(""))
        path = F.nullif(src["document_content_path"], F.lit(""))
        return (
            F.when(url.isNotNull(), F.concat(F.lit("- ["), title, F.lit("]("), url, F.lit(")")))
            .when(path.isNotNull(), F.concat(F.lit("- "), title, F.lit(" (vault: `"), path, F.lit("`)")))
            .otherwise(F.concat(F.lit("- "), title))
        )

    src = _col(sources)
    return F.when(F.coalesce(F.size(src), F.lit(0)) < 1, F.lit("No citations on this answer.")).otherwise(
        F.array_join(F.transform(src, bullet), "\n")
    )


def report_body(question: Column | str, answer: Column | str, sources: Column | str,
                correction: Column | str) -> Column:
    """Markdown report: escaped question and answer panels, citations, fenced correction."""
    short = collapse_space(question)
    quoted = F.when(
        F.length(short) > 500,
        F.concat(rstrip(F.substring(short, 1, 497)), F.lit(ELLIPSIS)),
    ).otherwise(short)
    fence = safe_fence(correction)
    return F.concat(
        F.lit("## User question\n\n> "), html_escape(quoted),
        F.lit("\n\nFull question:\n\n<pre>"), html_escape(question),
        F.lit("</pre>\n\n## Assistant answer\n\n<pre>"), html_escape(answer),
        F.lit("</pre>\n\n## Cited sources\n\n"), source_bullets(sources),
        F.lit("\n\n## Suggested correction\n\n"),
        fence, F.lit("\n"), _col(correction), F.lit("\n"), fence, F.lit("\n"),
    )


def citation_markdown(src: Column) -> Column:
    """A citation as a list item: breadcrumb label, deep link, quoted snippet."""
    crumbs = F.filter(F.coalesce(src["section_path"], F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")) != "")
    label = F.concat_ws(CRUMB, F.coalesce(src["document_title"], F.lit("")), F.nullif(F.array_join(crumbs, CRUMB), F.lit("")))
    url = F.nullif(src["document_url"], F.lit(""))
    target = F.concat(url, F.coalesce(F.concat(F.lit("#"), F.nullif(src["anchor"], F.lit(""))), F.lit("")))
    link = F.when(url.isNotNull(), F.concat(F.lit("["), label, F.lit("]("), target, F.lit(")"))).otherwise(label)
    snippet = strip(F.coalesce(src["content"], F.lit("")))
    quoted = F.when(snippet == "", F.lit("")).otherwise(
        F.concat(F.lit("\n  > "), F.replace(snippet, F.lit("\n"), F.lit("\n  > ")))
    )
    return F.concat(F.lit("- "), link, quoted)


def sources_markdown(sources: Column | str) -> Column:
    src = _col(sources)
    return F.when(F.coalesce(F.size(src), F.lit(0)) < 1, F.lit("")).otherwise(
        F.concat(F.lit("\n\n**Sources:**\n"), F.array_join(F.transform(src, citation_markdown), "\n"))
    )


def export_name(title: Column | str, day: Column) -> Column:
    """File name of an exported conversation: at most one dash is cut from each end of the slug."""
    dashed = F.regexp_replace(F.lower(_col(title)), "[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, "^-|-$", "")
    return F.concat(F.lit("conversation-"), slug, F.lit("-"), F.date_format(day, "yyyy-MM-dd"), F.lit(".md"))


def iso_utc(ts: Column | str) -> Column:
    """ISO-8601 text with milliseconds; the session time zone is UTC."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
