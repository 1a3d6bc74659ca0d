from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.sections import anchor_for, breadcrumbs, parse_sections, section_title


def lit(v):
    return F.lit(v)


def sections_of(spark, body):
    return spark.createDataFrame([(body,)], "b string").select(parse_sections("b").alias("s")).first()["s"]


def test_slugify(one):
    assert one(*[X.slugify(lit(s)) for s in ("Hello, World!", "  CMS_INPUT_DOM  ", "###", "Übung 2")]) == (
        "hello-world", "cms-input-dom", "", "bung-2")


def test_entities_and_preformatted_blocks(one):
    assert one(X.html_unescape(lit("caf&eacute; &#8217;&mdash;&#x1F600; &nope; & b &amp;lt; &nbsp;&apos;&#xD800;&#0;")))[0] == "café ’—😀 &nope; & b &lt;  '&#xD800;&#0;"
    page = "<main><p>x  y</p><pre class='a'><code>a = 1\n\n\n  b &lt; 2\n</code></pre><p>z</p></main>"
    assert one(X.html_to_markdown(lit(page)))[0] == "x y\n\n```\na = 1\n\n\n  b < 2\n```\n\nz"


def test_format_of_content_after_much_white_space(one):
    late = F.lit(" " * 5000 + "<html>").cast("binary")
    assert one(X.detect_format(late, F.lit(None).cast("string"))) == ("html",)


def test_detect_format(one):
    html, pdf, md = lit(b"  <p>x"), lit(b"%PDF-1.4"), lit(b"# title")
    none = lit(None).cast("string")
    assert one(
        X.detect_format(md, lit("TEXT/HTML; charset=utf-8")), X.detect_format(html, lit("application/pdf")),
        X.detect_format(html, lit("text/x-markdown")), X.detect_format(pdf, none), X.detect_format(html, none),
        X.detect_format(md, none), X.detect_format(pdf, lit("application/octet-stream")),
    ) == ("html", "pdf", "markdown", "pdf", "html", "markdown", "pdf")


def test_decoding(one):
    latin = lit("é<p>".encode("latin-1"))
    assert one(X.decode_html(latin), X.decode_html(lit("é".encode())), X.decode_markdown(latin)) == ("é<p>", "é", "�<p>")


def test_sections_levels_offsets_and_repeats(spark):
    body = "# Intro\n\ntext\n## Examples\n### Deep dive\n## Examples\n"
    got = [tuple(s) for s in sections_of(spark, body)]
    assert got == [
        (1, "Intro", 0, "intro"), (2, "Examples", 14, "examples"), (3, "Deep dive", 26, "deep-dive"),
        (2, "Examples", 40, "examples-1"),
    ]
    assert all(body[s[2]:].startswith("#" * s[0] + " " + s[1]) for s in got)


def test_section_edge_cases(spark):
    assert sections_of(spark, "") == [] and sections_of(spark, "plain\n#nospace\n####### seven") == []
    assert [s["text"] for s in sections_of(spark, "## Foo ##\n## C#\n# #\n#   \n")] == ["Foo", "C", "#"]
    # The counter belongs to the plain slug, so a numbered heading can collide.
    assert [s["anchor"] for s in sections_of(spark, "# Examples\n# Examples 1\n# Examples\n# 中文\n")] == [
        "examples", "examples-1", "examples-1", "section-4"]
    # Headings inside code fences count, and long documents keep exact offsets.
    body = "".join(f"line {i}\n# h{i}\n" for i in range(700))
    assert all(body[s["char_offset"]:].startswith(f"# {s['text']}\n") for s in sections_of(spark, body))


def test_titles_and_breadcrumbs(spark):
    df = spark.createDataFrame([("## First\n# Top\n### Sub\n## Next",), ("## Only",), ("none",)], "b string").select(
        parse_sections("b").alias("s"))
    assert [r[0] for r in df.select(section_title("s")).collect()] == ["Top", "Only", None]
    assert df.select(breadcrumbs(F.col("s"))).first()[0] == [["First"], ["Top"], ["Top", "Sub"], ["Top", "Next"]]


def test_anchor_takes_the_last_of_equal_headings(spark):
    df = spark.createDataFrame([("# Examples\n# Examples\n",)], "b string").select(parse_sections("b").alias("s"))
    assert tuple(df.select(
        anchor_for(lit("Examples"), F.col("s")), anchor_for(lit("New One"), F.col("s")), anchor_for(lit("!!"), F.col("s"))
    ).first()) == ("examples-1", "new-one", None)


def test_html_page_keeps_main_text(one):
    page = lit(
        "<html lang='x'><head><title> My \n Page </title><style>p{}</style></head><body><nav><a>Home</a></nav>"
        "<!-- note --><script>var a='</p>';</script><main><h1>Head &amp; Shoulders</h1><p>One<br>two</p>"
        "<ul><li>a</li><li>b <b>bold</li></ul></main><footer>legal</footer><script>open"
    )
    md, title = one(X.html_to_markdown(page), X.html_title(page))
    assert md == "# Head & Shoulders\n\nOne\ntwo\n\n- a\n- b bold"
    assert title == "My Page"
    assert one(X.html_to_markdown(lit("<nav>x</nav>")), X.html_title(lit("<p>"))) == ("", None)
    assert one(X.html_to_markdown(lit("<p>&amp;lt;</p>")))[0] == "&lt;"


def test_markers(one):
    text = lit("A [c:x-1] b [c:y_2][c:x-1] [c:] [d:z]")
    assert one(X.cited_ids(text), X.strip_markers(text)) == (["x-1", "y_2"], "A  b  [c:] [d:z]")


def test_refusals(one):
    assert one(
        X.is_refusal(lit("Sorry, THE documentation library does not cover that topic.")),
        X.is_refusal(lit("This is outside the scope of the Acme documentation"), "Acme"),
        X.is_refusal(lit("This is outside the scope of the other documentation"), "Acme"),
        X.is_refusal(lit("The answer is 4.")), X.is_refusal(lit(None).cast("string")),
    ) == (True, True, False, False, False)
    assert len(X.REFUSAL_PHRASES) == 18


def test_tokens(one):
    assert one(X.token_count(lit("Hi, you_2!")), X.truncate_tokens(lit("a b  c d"), 3), X.truncate_tokens(lit(" a b "), 3),
               X.token_count(lit("x" * 40))) == (4, "a b  c", " a b ", 3)


def test_shortening(one):
    long = "w" * 60
    assert one(
        X.auto_title(lit("New Conversation"), lit(long)), X.auto_title(lit("New Conversation"), lit(" short ")),
        X.auto_title(lit("Mine"), lit(long)), X.auto_title(lit("New Conversation"), lit(None).cast("string")),
        X.shorten(lit("x" * 81), 80, 77), X.shorten(lit("x" * 80), 80, 77),
    ) == ("w" * 47 + "…", "short", "Mine", "New Conversation", "x" * 77 + "…", "x" * 80)


def test_report_title(one):
    assert one(X.report_title(lit("  a\n b ")), X.report_title(lit(" ")), X.report_title(lit("q" * 81))) == (
        "Answer feedback: a b", "Answer feedback: (no question)", "Answer feedback: " + "q" * 79 + "…")


def test_report_body(spark, one):
    src = F.from_json(lit(
        '[{"document_title":"T","document_url":"https://e.com"},{"document_title":"V","document_content_path":"v.md"},{"document_title":""}]'
    ), "array<struct<document_title:string,document_url:string,document_content_path:string>>")
    body, = one(X.report_body(lit("<b>\"q\" 'a' & b"), lit("ans"), src, lit("x ````y```` z")))
    assert "> &lt;b&gt;&quot;q&quot; &#x27;a&#x27; &amp; b\n" in body
    assert "- [T](https://e.com)\n- V (vault: `v.md`)\n- (untitled)\n" in body
    assert body.endswith("`````\nx ````y```` z\n`````\n")
    assert one(X.safe_fence(lit("plain")), X.source_bullets(F.array().cast(
        "array<struct<document_title:string,document_url:string,document_content_path:string>>"))) == (
        "```", "No citations on this answer.")
    long, = one(X.report_body(lit("q" * 600), lit("a"), src, lit("c")))
    assert "> " + "q" * 497 + "…\n" in long and "<pre>" + "q" * 600 + "</pre>" in long


def test_citation_markdown(spark):
    shape = "s array<struct<document_title:string,document_url:string,section_path:array<string>,anchor:string,content:string>>"
    rows = [
        ([("Doc", "https://e.com", ["A", "", "B"], "b", " one\ntwo ")],), ([("Doc", "https://e.com", [], None, "  ")],),
        ([("Doc", None, None, "b", None)],), ([],), (None,),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, shape).select(X.sources_markdown("s")).collect()]
    lead = "\n\n**Sources:**\n"
    assert got == [lead + "- [Doc › A › B](https://e.com#b)\n  > one\n  > two", lead + "- [Doc](https://e.com)", lead + "- Doc", "", ""]


def test_export_name_and_dates(one):
    day = lit("2024-05-06 01:02:03").cast("timestamp")
    assert one(X.export_name(lit("  Hello, World! "), day), X.iso_utc(day)) == (
        "conversation-hello-world-2024-05-06.md", "2024-05-06T01:02:03.000Z")


def test_contains_folded(spark):
    df = spark.createDataFrame([("Alpha", "", None), ("b", "ÉTÉ x", "u")], "t string, d string, u string")
    q = lambda s: [r[0] for r in df.select(X.contains_folded(["t", "d", "u"], lit(s))).collect()]
    assert q(" ALPHA ") == [True, False] and q("été") == [False, True] and q("b é") == [False, True] and q("%") == [False, False]
