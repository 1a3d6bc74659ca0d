import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalog, citations, conversations, feedback, ordered, toolcalls
from quillspark.sources.exports import write_conversations


@pytest.fixture(scope="module")
def talk(spark):
    convs = spark.createDataFrame(
        [("c1", "u1", "New Conversation", 1, 5), ("c2", "u2", "Second", 2, 9), ("c3", "u1", "Empty", 3, 3)],
        "conversation_id string, user_id string, title string, created_at int, updated_at int")
    msgs = spark.createDataFrame([
        ("m0", "c1", 0, "assistant", "hello", 1), ("m1", "c1", 1, "user", "  why? ", 2), ("m2", "c1", 2, "assistant", "because", 3),
        ("m3", "c1", 3, "assistant", "also", 4), ("m4", "c2", 0, "user", "q", 5),
    ], "message_id string, conversation_id string, turn int, role string, content string, created_at int")
    given = spark.createDataFrame([
        ("f1", "m2", "c1", "u1", "this is long enough", 1), ("f2", "m2", "c1", "u1", "newer correction", 2),
        ("f3", "m1", "c1", "u1", "on a user message", 3), ("f4", "m2", "c1", "u2", "by another user", 4),
        ("f5", "m0", "c1", "u1", "no question before", 5), ("f6", "m2", "c1", "u1", "   short   ", 6), ("f7", "m2", "c1", "u1", "x" * 5001, 7),
    ], "feedback_id string, message_id string, conversation_id string, user_id string, suggested_correction string, created_at int")
    return convs, msgs, given


def column(df, name):
    return sorted(r[name] for r in df.collect())


def test_list_and_previews(talk):
    convs, msgs, _ = talk
    listed = conversations.conversation_list(convs, msgs)
    assert {r["conversation_id"]: r["preview"] for r in listed.collect()} == {"c1": "also", "c2": "q", "c3": None}
    assert column(conversations.visible_conversations(listed), "conversation_id") == ["c1", "c2"]
    assert column(conversations.visible_conversations(listed, " SECOND "), "conversation_id") == ["c2"]
    assert column(conversations.conversation_list(convs, msgs, "u1"), "conversation_id") == ["c1", "c3"]


def test_search_is_like_with_wildcards(talk):
    convs, _, _ = talk
    found = lambda q, **kw: [r["conversation_id"] for r in conversations.search_conversations(convs, q, **kw).collect()]
    assert found("CON") == ["c2", "c1"] and found("n%c") == ["c1"] and found("_econd") == ["c2"] and found("e", limit=2) == ["c2", "c1"] and found("e", user_id="u1") == ["c1", "c3"]


def test_titles(talk):
    convs, msgs, _ = talk
    titled = conversations.titled_conversations(convs, msgs)
    assert {r["conversation_id"]: r["title"] for r in titled.collect()} == {"c1": "why?", "c2": "Second", "c3": "Empty"}


def test_ownership_and_guards(spark, talk):
    convs, msgs, _ = talk
    asked = spark.createDataFrame([("u1", "c1"), ("u1", "c2"), ("u9", "c1")], "user_id string, conversation_id string")
    assert column(conversations.owned_messages(asked, convs, msgs), "message_id") == ["m0", "m1", "m2", "m3"]
    new = spark.createDataFrame([
        ("n1", "c1", "u1", "user", "hi", 50), ("n2", "c1", "u2", "user", "hi", 60), ("n3", "zz", "u1", "user", "hi", 1),
        ("n4", "c1", "u1", "user", "  ", 70), ("n5", "c1", "u1", "system", "hi", 80),
    ], "message_id string, conversation_id string, user_id string, role string, content string, created_at int")
    yes, no = conversations.guarded_messages(new, convs)
    assert column(yes, "message_id") == ["n1"] and column(no, "message_id") == ["n2", "n3", "n4", "n5"]
    assert {r["conversation_id"]: r["updated_at"] for r in conversations.touch(convs, yes).collect()} == {"c1": 50, "c2": 9, "c3": 3}


def test_feedback(talk):
    convs, msgs, given = talk
    assert column(feedback.valid_corrections(given), "feedback_id") == ["f1", "f2", "f3", "f4", "f5"]
    assert column(feedback.guarded_feedback(given, msgs, convs), "feedback_id") == ["f1", "f2", "f5", "f6", "f7"]
    latest = {r["message_id"]: r["feedback_id"] for r in feedback.latest_feedback(given).collect()}
    assert latest == {"m0": "f5", "m1": "f3", "m2": "f7"}
    flags = conversations.with_feedback_flag(msgs, given)
    assert {r["message_id"]: r["feedback_submitted"] for r in flags.collect()} == {"m0": True, "m1": True, "m2": True, "m3": False, "m4": False}


def test_reports(talk):
    convs, msgs, given = talk
    rows = {r["feedback_id"]: r for r in feedback.build_feedback_reports(given, msgs, convs).collect()}
    assert set(rows) == {"f1", "f2"}
    assert json.loads(rows["f1"]["payload_json"]) == {"question": "  why? ", "answer": "because", "citations": []}
    assert rows["f1"]["title"] == "Answer feedback: why?" and "```\nthis is long enough\n```" in rows["f1"]["body"]


def test_payload_keeps_null_keys(spark):
    src = spark.createDataFrame([([("T", "https://e.com", None), (None, None, "v.md")],)],
                                "sources array<struct<document_title:string,document_url:string,document_content_path:string>>")
    text = src.select(feedback.payload_json(F.lit("q"), F.lit("a"), "sources").alias("p")).first()["p"]
    assert json.loads(text)["citations"] == [
        {"title": "T", "url": "https://e.com", "content_path": None}, {"title": None, "url": None, "content_path": "v.md"}]


def test_question_before_answer(talk):
    _, msgs, _ = talk
    pairs = {r["message_id"]: r["question"] for r in conversations.question_answer_pairs(msgs).collect()}
    assert pairs == {"m0": None, "m2": "  why? ", "m3": "  why? "}


@pytest.mark.parametrize("block", [1, 3, 7, 65_536])
def test_ordered_scans_in_blocks_equal_the_whole(spark, block):
    rows = [(k, i, None if (i * 7 + len(k)) % 5 else f"{k}{i}", i % 4) for k, n in (("hot", 60), ("a", 3), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v string, n int")
    seen = {(r["k"], r["i"]): r["p"] for r in ordered.last_before(df, ["k"], "i", F.col("v"), "p", block).collect()}
    sums = {(r["k"], r["i"]): r["s"] for r in ordered.running_sum(df, ["k"], "i", F.col("n"), "s", block).collect()}
    for k, i, _, _ in rows:
        before = [v for kk, ii, v, _ in rows if kk == k and ii < i and v is not None]
        assert seen[(k, i)] == (before[-1] if before else None)
        assert sums[(k, i)] == sum(n for kk, ii, _, n in rows if kk == k and ii <= i)
    one_key = df.where("k = 'hot'")
    ranks = {r["i"]: r["n1"] for r in ordered.global_rank(one_key, "i", "n1", block, descending=True).collect()}
    assert ranks == {i: 60 - i for i in range(60)}


def test_cascade(talk):
    convs, msgs, given = talk
    left = conversations.delete_conversations(convs.where("conversation_id = 'c1'"), convs, msgs, given)
    assert [df.count() for df in left] == [2, 1, 0]


def test_export_parts(spark, talk, tmp_path):
    convs, msgs, _ = talk
    stamp = F.lit("2024-05-06 07:08:09").cast("timestamp")
    whole = {r["conversation_id"]: r for r in conversations.conversation_markdown(convs, msgs, stamp).collect()}
    assert whole["c2"]["markdown"] == "# Second\n\n2024-05-06T07:08:09.000Z\n\n---\n\n**You:** q\n\n"
    assert whole["c3"]["markdown"].endswith("---\n\n") and whole["c1"]["file_name"] == "conversation-new-conversation-2024-05-06.md"
    parts = conversations.conversation_markdown(convs, msgs, stamp, part_turns=2)
    joined = "".join(r["markdown"] for r in parts.where("conversation_id = 'c1'").orderBy("part").collect())
    assert joined == whole["c1"]["markdown"] and "**Assistant:** because" in joined
    write_conversations(parts, str(tmp_path / "out"))
    folders = sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir())
    assert folders == [f"conversation=conversation-{n}-2024-05-06_{c}" for n, c in
                       (("empty", "c3"), ("new-conversation", "c1"), ("second", "c2"))]


# --- catalog ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library(spark):
    return spark.createDataFrame([
        (1, "a", "Setup ODFS", "first", "https://e.com/a", None, "docs", 10), (2, "b", "", "guide to odfs", None, "b.md", "docs", 20),
        (3, "c", "Other", "", None, None, "vault", 30),
    ], "n int, document_id string, title string, description string, url string, content_path string, source_type string, created_at int")


def test_catalog(spark, library):
    assert [r["document_id"] for r in catalog.catalog(library).collect()] == ["c", "b", "a"]
    assert [r["document_id"] for r in catalog.catalog(library, ["docs"]).collect()] == ["b", "a"]
    assert catalog.catalog(library, []).count() == 0
    lines = [r["line"] for r in catalog.catalog_lines(library, "n").orderBy("n").collect()]
    assert lines == ["1. Other (id=c)", "2. Untitled (id=b) — b.md", "3. Setup ODFS (id=a) — https://e.com/a"]


def test_document_search(spark, library):
    chunks = spark.createDataFrame([("a",), ("a",)], "document_id string")
    rows = {r["document_id"]: r["chunk_count"] for r in catalog.search_documents(library, chunks, "odfs").collect()}
    assert rows == {"a": 2, "b": 0}
    assert catalog.search_documents(library, chunks, "odfs", limit=1).first()["document_id"] == "b"
    assert column(catalog.filter_documents(library, " B.MD "), "document_id") == ["b"]
    assert catalog.filter_documents(library, "  ").count() == 3 and catalog.filter_documents(library, "%").count() == 0
    counts = {r["kind"]: r["n"] for r in catalog.corpus_counts(library, chunks, chunks).collect()}
    assert counts == {"documents": 3, "chunks": 2, "vectors": 2}


# --- citations and turn logs --------------------------------------------------------------------


def test_resolve_citations(spark):
    rows = [("m", p, cid, doc, i) for p, (cid, doc, i) in enumerate([
        ("a3", "A", 3), ("b1", "B", 1), ("a1", "A", 1), ("a3", "A", 3), ("", "A", 0), ("c5", "C", 5), ("c2", "C", 2), ("d1", "D", 1)])]
    rows += [("r", 0, "a3", "A", 3)]
    got = spark.createDataFrame(rows, "message_id string, pos int, chunk_id string, document_id string, chunk_index int")
    answers = spark.createDataFrame([
        ("m", "First [c:b1]. See [c:c5] and [c:c2].", "See [c:c5] and [c:c2]."),
        ("r", "x [c:a3] not covered in the documentation", "x [c:a3] not covered in the documentation"), ("n", "plain", "plain"),
    ], "message_id string, answer string, final_text string")
    out = {r["message_id"]: r for r in citations.resolve_citations(answers, got, max_uncited=2).collect()}
    # Only the final round counts, one chip per document, the lowest cited chunk shows.
    assert [(s["chunk_id"], s["is_cited"]) for s in out["m"]["sources"]] == [("c2", True), ("a1", False), ("b1", False)]
    assert out["m"]["content"] == "First . See  and ."
    assert out["r"]["is_refusal"] and out["r"]["sources"] is None
    assert out["n"]["sources"] is None and not out["n"]["is_refusal"]


def test_tool_calls(spark):
    frags = spark.createDataFrame([
        (1, 0, 1, 0, "id1", None, "get", '{"a"'), (1, 0, 0, 1, "id0", "function", "search", ""), (1, 0, 1, 2, "", None, "", ": 1}"), (1, 0, 0, 3, None, None, None, "{}"),
    ], "turn_id int, round int, idx int, seq int, call_id string, call_type string, name string, arguments string")
    rows = [tuple(r) for r in toolcalls.assemble_tool_calls(frags).orderBy("idx").collect()]
    assert rows == [(1, 0, 0, "id0", "function", "search", "{}"), (1, 0, 1, "id1", "function", "get", '{"a": 1}')]
    calls = spark.createDataFrame([(1, r, i) for r in range(3) for i in range(3)], "turn_id int, round int, idx int")
    capped = toolcalls.cap_tool_calls(calls, 4).orderBy("round", "idx").collect()
    assert [r["capped"] for r in capped] == [False] * 4 + [True] * 5


@pytest.mark.parametrize("frame,text", [
    ('data: "he\\nllo"\n\n', "he\nllo"), ("data: raw text\n\n", "raw text"), ("data: [DONE]\n\n", None), ('data: {"error": "x"}\n\n', None),
    ("event: status\ndata: {}\n\n", None), (": keepalive\n\n", None), ("data: 12\n\n", None), ("data: null\n\n", None), ('data: "a" b\n\n', '"a" b'), ("data: \n\n", None), ('data: {"a": 1}\n\n', None),
])
def test_frame_payload(one, frame, text):
    assert one(toolcalls.frame_payload(F.lit(frame)))[0] == text


@pytest.mark.parametrize("block,kind,text", [
    ("event: sources\ndata: [{}]", "sources", None), ('event:status\ndata: {"type":"x"}', "status", None), ("data: [DONE]", "done", None),
    ('data: {"error": "boom"}', "error", "boom"), ('data:"tok"', "token", "tok"), ("data: a\ndata:  b", "token", "a\n b"), (": ping", "empty", None),
    ('data: {"error" broken', "error", "Stream error from server"),
])
def test_parse_event(one, block, kind, text):
    e, = one(toolcalls.parse_event(F.lit(block)))
    assert (e["kind"], e["text"]) == (kind, text)
