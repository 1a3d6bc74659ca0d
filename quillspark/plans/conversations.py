"""Queries over conversations, messages, feedback, answers and their logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.text import cited_ids, export_name, is_refusal, shorten, strip_markers
from ..operators import citations as cit
from ..operators import conversations as conv
from ..operators import feedback as fb
from ..operators import toolcalls as tc
from . import tables as T
from .registry import query

STAMP = "%Y-%m-%d %H:%M:%S"


def _stamp(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(T.with_ctes(T.CONVS) + f"""
SELECT c.conversation_id, c.user_id, c.title, strftime(c.updated_at, '{STAMP}') AS updated_at,
       (SELECT arg_max(m.content, m.turn) FROM msgs m WHERE m.conversation_id = c.conversation_id) AS preview
FROM convs c""")
def conversation_list(spark, sf_dir):
    listed = conv.conversation_list(T.conversations(spark, sf_dir), T.messages(spark, sf_dir))
    return listed.select("conversation_id", "user_id", "title", _stamp("updated_at"), "preview").orderBy(
        F.desc("updated_at"), "conversation_id"
    )


@query(T.with_ctes(T.CONVS) + """
SELECT conversation_id, title FROM convs c
WHERE EXISTS (SELECT 1 FROM msgs m WHERE m.conversation_id = c.conversation_id) AND contains(lower(title), 'talk: no. 1')""")
def visible_conversations(spark, sf_dir):
    listed = conv.conversation_list(T.conversations(spark, sf_dir), T.messages(spark, sf_dir))
    return conv.visible_conversations(listed, " TALK: no. 1 ").select("conversation_id", "title")


@query(T.with_ctes(T.CONVS) + f"""
SELECT conversation_id, title, strftime(created_at, '{STAMP}') AS created_at, strftime(updated_at, '{STAMP}') AS updated_at
FROM convs WHERE title ILIKE '%talk_ no%5%' ORDER BY updated_at DESC, conversation_id LIMIT 20""")
def conversation_search(spark, sf_dir):
    found = conv.search_conversations(T.conversations(spark, sf_dir), "TALK_ no%5")
    return found.select("conversation_id", "title", _stamp("created_at"), _stamp("updated_at"))


FIRST_USER = """
first_user AS (SELECT conversation_id, trim(arg_min(content, turn)) AS msg FROM msgs WHERE role = 'user' GROUP BY conversation_id),
titled AS (
  SELECT c.conversation_id, c.created_at, CASE WHEN c.title <> 'New Conversation' OR f.msg IS NULL THEN c.title
         WHEN length(f.msg) > 50 THEN trim(substr(f.msg, 1, 47), %s) || '…' ELSE f.msg END AS title
  FROM convs c LEFT JOIN first_user f USING (conversation_id)
)""" % T.WS


@query(T.with_ctes(T.CONVS, FIRST_USER) + "SELECT conversation_id, title FROM titled")
def conversation_titles(spark, sf_dir):
    return conv.titled_conversations(T.conversations(spark, sf_dir), T.messages(spark, sf_dir)).select(
        "conversation_id", "title"
    )


@query(T.with_ctes(T.CONVS) + """
SELECT message_id, CASE WHEN length(content) > 80 THEN substr(content, 1, 77) || '…' ELSE content END AS preview FROM msgs""")
def previews(spark, sf_dir):
    return T.messages(spark, sf_dir).select("message_id", shorten("content", 80, 77).alias("preview"))


@query(T.with_ctes(T.CONVS, T.FEEDBACK) + """
, accepted AS (SELECT * FROM fb WHERE length(trim(suggested_correction)) >= 10 AND user_id <> 'u9')
SELECT m.message_id, m.role, EXISTS (SELECT 1 FROM accepted a WHERE a.message_id = m.message_id) AS feedback_submitted FROM msgs m""")
def messages_with_feedback(spark, sf_dir):
    given = fb.valid_corrections(T.feedback(spark, sf_dir)).where("user_id <> 'u9'")
    return conv.with_feedback_flag(T.messages(spark, sf_dir), given).select("message_id", "role", "feedback_submitted")


@query(T.with_ctes(T.CONVS) + """
, asked AS (SELECT 'u' || (conv_id % 6) AS user_id, conversation_id FROM convs)
SELECT m.message_id, a.user_id, m.role FROM asked a JOIN convs c ON c.conversation_id = a.conversation_id AND c.user_id = a.user_id
JOIN msgs m ON m.conversation_id = a.conversation_id""")
def owned_messages(spark, sf_dir):
    convs = T.conversations(spark, sf_dir)
    asked = convs.select(F.concat(F.lit("u"), (F.col("conv_id") % 6).cast("string")).alias("user_id"), "conversation_id")
    return conv.owned_messages(asked, convs, T.messages(spark, sf_dir)).select("message_id", "user_id", "role").orderBy("message_id")


@query(T.with_ctes(T.CONVS, T.FEEDBACK) + """
, asked AS (SELECT 'u' || (conv_id % 6) AS user_id, conversation_id FROM convs),
accepted AS (SELECT * FROM fb WHERE length(trim(suggested_correction)) >= 10 AND user_id <> 'u9')
SELECT a.user_id, a.conversation_id, c.title, m.message_id, m.role, m.content,
       row_number() OVER (PARTITION BY m.conversation_id ORDER BY m.turn) - 1 AS position,
       EXISTS (SELECT 1 FROM accepted f WHERE f.message_id = m.message_id) AS feedback_submitted
FROM asked a JOIN convs c ON c.conversation_id = a.conversation_id AND c.user_id = a.user_id
JOIN msgs m ON m.conversation_id = a.conversation_id""")
def conversation_detail(spark, sf_dir):
    convs = T.conversations(spark, sf_dir)
    asked = convs.select(F.concat(F.lit("u"), (F.col("conv_id") % 6).cast("string")).alias("user_id"), "conversation_id")
    given = fb.valid_corrections(T.feedback(spark, sf_dir)).where("user_id <> 'u9'")
    return conv.conversation_detail(asked, convs, T.messages(spark, sf_dir), given)


def _new_messages(spark, sf_dir):
    turns = T.load(spark, sf_dir, "conversations")
    return turns.select(
        F.concat(F.lit("n"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("message_id"),
        F.concat(F.lit("c"), (F.col("conv_id") + F.col("turn") % 2 * 1_000_000).cast("string")).alias("conversation_id"),
        F.concat(F.lit("u"), (F.col("conv_id") % (F.col("turn") % 3 + 6)).cast("string")).alias("user_id"),
        "role", F.when(F.col("turn") == 5, F.lit(" \n ")).otherwise(F.col("text")).alias("content"),
    )


@query(T.with_ctes(T.CONVS) + """
, news AS (
  SELECT 'n' || conv_id || '-' || turn AS message_id, 'c' || (conv_id + turn % 2 * 1000000) AS conversation_id,
         'u' || (conv_id % (turn % 3 + 6)) AS user_id, role, CASE WHEN turn = 5 THEN '' ELSE text END AS content
  FROM conversations
)
SELECT n.message_id, n.content <> '' AND n.role IN ('user', 'assistant') AND EXISTS (
  SELECT 1 FROM convs c WHERE c.conversation_id = n.conversation_id AND c.user_id = n.user_id) AS accepted FROM news n""")
def guarded_insert(spark, sf_dir):
    yes, no = conv.guarded_messages(_new_messages(spark, sf_dir), T.conversations(spark, sf_dir))
    return yes.select("message_id", F.lit(True).alias("accepted")).unionByName(
        no.select("message_id", F.lit(False).alias("accepted"))
    )


@query(T.with_ctes(T.CONVS, T.FEEDBACK) + """
SELECT feedback_id, message_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, feedback_id DESC) AS n FROM fb)
WHERE n = 1""")
def latest_feedback(spark, sf_dir):
    return fb.latest_feedback(T.feedback(spark, sf_dir)).select("feedback_id", "message_id")


@query(T.with_ctes(T.CONVS, T.FEEDBACK) + """
, gone AS (SELECT conversation_id FROM convs WHERE title = 'New Conversation')
SELECT 'conversations' AS kind, conversation_id AS id FROM convs WHERE conversation_id NOT IN (FROM gone)
UNION ALL SELECT 'messages', message_id FROM msgs WHERE conversation_id NOT IN (FROM gone)
UNION ALL SELECT 'feedback', feedback_id FROM fb WHERE conversation_id NOT IN (FROM gone)""")
def cascade_delete(spark, sf_dir):
    convs = T.conversations(spark, sf_dir)
    gone = convs.where("title = 'New Conversation'").select("conversation_id")
    left = conv.delete_conversations(gone, convs, T.messages(spark, sf_dir), T.feedback(spark, sf_dir))
    named = [df.select(F.lit(kind).alias("kind"), F.col(key).alias("id")) for df, kind, key in zip(
        left, ("conversations", "messages", "feedback"), ("conversation_id", "message_id", "feedback_id"))]
    return named[0].unionByName(named[1]).unionByName(named[2])


# --- pairs, reports, export ---------------------------------------------------------------

PAIRS = """
pairs AS (
  SELECT a.message_id, a.conversation_id, a.conv_id, a.content AS answer,
         (SELECT arg_max(u.content, u.turn) FROM msgs u WHERE u.conversation_id = a.conversation_id AND u.role = 'user' AND u.turn < a.turn) AS question
  FROM msgs a WHERE a.role = 'assistant'
)"""


@query(T.with_ctes(T.CONVS, PAIRS) + "SELECT message_id, question, answer FROM pairs")
def question_answer_pairs(spark, sf_dir):
    return conv.question_answer_pairs(T.messages(spark, sf_dir)).select("message_id", "question", "answer")


def _escape_sql(x: str) -> str:
    for raw, ent in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{raw}', '{ent}')"
    return x


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


NL = "' || chr(10) || '"
REPORTS = PAIRS + f""",
reports AS (
  SELECT f.feedback_id, p.*, f.suggested_correction AS fix, {_flat('question')} AS flat
  FROM fb f JOIN pairs p USING (message_id) JOIN convs c ON c.conversation_id = p.conversation_id AND c.user_id = f.user_id
  WHERE length(trim(f.suggested_correction)) >= 10 AND length(f.suggested_correction) <= 5000 AND question IS NOT NULL
)"""


@query(T.with_ctes(T.CONVS, T.FEEDBACK, REPORTS) + f"""
SELECT feedback_id, 'Answer feedback: ' || CASE WHEN flat = '' THEN '(no question)' WHEN length(flat) > 80 THEN rtrim(substr(flat, 1, 79)) || '…' ELSE flat END AS title,
  '## User question{NL}{NL}> ' || {_escape_sql("CASE WHEN length(flat) > 500 THEN rtrim(substr(flat, 1, 497)) || '…' ELSE flat END")}
  || '{NL}{NL}Full question:{NL}{NL}<pre>' || {_escape_sql('question')} || '</pre>{NL}{NL}## Assistant answer{NL}{NL}<pre>' || {_escape_sql('answer')}
  || '</pre>{NL}{NL}## Cited sources{NL}{NL}' || CASE WHEN conv_id % 2 = 0 THEN '- [Title d' || conv_id || '](https://docs.example.com/d' || conv_id || ')'
       WHEN conv_id % 4 = 1 THEN '- Title d' || conv_id || ' (vault: `d' || conv_id || '.md`)' ELSE '- Title d' || conv_id END
  || '{NL}{NL}## Suggested correction{NL}{NL}````{NL}' || fix || '{NL}````{NL}' AS body
FROM reports""")
def feedback_reports(spark, sf_dir):
    return fb.build_feedback_reports(
        T.feedback(spark, sf_dir), _messages_with_sources(spark, sf_dir), T.conversations(spark, sf_dir)
    ).select("feedback_id", "title", "body")


def _messages_with_sources(spark, sf_dir):
    doc = F.concat(F.lit("d"), F.col("conv_id").cast("string"))
    n = F.col("conv_id")
    src = F.array(F.struct(
        F.concat(F.lit("Title "), doc).alias("document_title"),
        F.when(n % 2 == 0, F.concat(F.lit(T.SITE), doc)).alias("document_url"),
        F.when(n % 4 == 1, F.concat(doc, F.lit(".md"))).alias("document_content_path"),
        F.array(F.lit("Guide"), F.lit(""), doc).alias("section_path"),
        F.when(n % 3 == 0, F.lit("top")).alias("anchor"),
        F.when(n % 5 != 0, F.concat(F.lit(" quoted\ntext "), doc)).alias("content"),
    ))
    return T.messages(spark, sf_dir).withColumn("sources", F.when(F.col("role") == "assistant", src))


@query(T.with_ctes(T.CONVS, T.FEEDBACK, REPORTS) + f"""
SELECT feedback_id, question AS q, answer AS a, 'Title d' || conv_id AS cited_title,
       CASE WHEN conv_id % 2 = 0 THEN 'https://docs.example.com/d' || conv_id END AS cited_url, 1 AS n_citations FROM reports""")
def feedback_payload(spark, sf_dir):
    reports = fb.build_feedback_reports(
        T.feedback(spark, sf_dir), _messages_with_sources(spark, sf_dir), T.conversations(spark, sf_dir)
    )
    shape = "question string, answer string, citations array<struct<title:string,url:string,content_path:string>>"
    return reports.select("feedback_id", F.from_json("payload_json", shape).alias("p")).select(
        "feedback_id", F.col("p.question").alias("q"), F.col("p.answer").alias("a"),
        F.col("p.citations")[0]["title"].alias("cited_title"), F.col("p.citations")[0]["url"].alias("cited_url"),
        F.size("p.citations").alias("n_citations"),
    )


CITATION_SQL = f"""'- ' || CASE WHEN conv_id % 2 = 0
   THEN '[Title d' || conv_id || ' › Guide › d' || conv_id || '](https://docs.example.com/d' || conv_id || CASE WHEN conv_id % 3 = 0 THEN '#top' ELSE '' END || ')'
   ELSE 'Title d' || conv_id || ' › Guide › d' || conv_id END
  || CASE WHEN conv_id % 5 <> 0 THEN '{NL}  > quoted{NL}  > text d' || conv_id ELSE '' END"""


@query(T.with_ctes(T.CONVS) + f"""
SELECT message_id, '{NL}{NL}**Sources:**{NL}' || {CITATION_SQL} AS markdown FROM msgs WHERE role = 'assistant'""")
def citation_markdown(spark, sf_dir):
    from ..functions.text import sources_markdown

    return _messages_with_sources(spark, sf_dir).where("role = 'assistant'").select(
        "message_id", sources_markdown("sources").alias("markdown")
    )


@query(T.with_ctes(T.CONVS) + f"""
, turns AS (
  SELECT conversation_id, turn // 3 AS part, string_agg(CASE WHEN role = 'user' THEN '**You:** ' ELSE '**Assistant:** ' END || content
    || CASE WHEN role = 'assistant' THEN '{NL}{NL}**Sources:**{NL}' || {CITATION_SQL} ELSE '' END || '{NL}{NL}', '' ORDER BY turn) AS body
  FROM msgs GROUP BY conversation_id, turn // 3
),
heads AS (SELECT conversation_id, 0 AS part, '# ' || title || '{NL}{NL}2024-05-06T07:08:09.000Z{NL}{NL}---{NL}{NL}' AS head FROM convs)
SELECT coalesce(t.conversation_id, h.conversation_id) AS conversation_id, coalesce(t.part, h.part) AS part,
       'conversation-' || trim(regexp_replace(lower(c.title), '[^a-z0-9]+', '-', 'g'), '-') || '-2024-05-06.md' AS file_name,
       coalesce(head, '') || coalesce(body, '') AS markdown
FROM turns t FULL JOIN heads h ON h.conversation_id = t.conversation_id AND h.part = t.part
JOIN convs c ON c.conversation_id = coalesce(t.conversation_id, h.conversation_id)""")
def conversation_markdown(spark, sf_dir):
    return conv.conversation_markdown(
        T.conversations(spark, sf_dir), _messages_with_sources(spark, sf_dir),
        F.lit("2024-05-06 07:08:09").cast("timestamp"), part_turns=3,
    )


@query(T.with_ctes(T.CONVS, FIRST_USER) + """
SELECT conversation_id, 'conversation-' || regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')
  || '-' || strftime(created_at, '%Y-%m-%d') || '.md' AS file_name FROM titled""")
def export_names(spark, sf_dir):
    titled = conv.titled_conversations(T.conversations(spark, sf_dir), T.messages(spark, sf_dir))
    return titled.select("conversation_id", export_name("title", F.col("created_at")).alias("file_name"))


# --- citations of answers --------------------------------------------------------------------

MARK = "\\[c:[A-Za-z0-9_-]+\\]"


@query(T.with_ctes(T.CONVS, T.ANSWERS) + """
SELECT DISTINCT message_id, unnest(regexp_extract_all(answer, '\\[c:([A-Za-z0-9_-]+)\\]', 1)) AS chunk_id FROM answers""")
def cited_chunks(spark, sf_dir):
    return T.answers(spark, sf_dir).select("message_id", F.explode(cited_ids("answer")).alias("chunk_id"))


@query(T.with_ctes(T.CONVS, T.ANSWERS) + f"""
SELECT message_id, regexp_replace(answer, '{MARK}', '', 'g') AS content FROM answers""")
def stripped_answers(spark, sf_dir):
    return T.answers(spark, sf_dir).select("message_id", strip_markers("answer").alias("content"))


@query(T.with_ctes(T.CONVS, T.ANSWERS) + """
SELECT message_id, contains(lower(final_text), 'i could not find this in the documentation') AS is_refusal FROM answers""")
def refusals(spark, sf_dir):
    return T.answers(spark, sf_dir).select("message_id", is_refusal("final_text").alias("is_refusal"))


@query(T.with_ctes(T.CONVS, T.ANSWERS) + """
, firsts AS (SELECT message_id, chunk_id, min(pos) AS pos, any_value(document_id) AS document_id, any_value(chunk_index) AS chunk_index
             FROM retrieved GROUP BY message_id, chunk_id),
flagged AS (SELECT f.*, contains(a.final_text, '[c:' || f.chunk_id || ']') AS is_cited FROM firsts f JOIN answers a USING (message_id)),
docs_ AS (SELECT message_id, document_id, min(pos) AS pos, bool_or(is_cited) AS is_cited,
                 coalesce(min(chunk_index) FILTER (is_cited), min(chunk_index)) AS chunk_index FROM flagged GROUP BY message_id, document_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY message_id, is_cited ORDER BY pos) AS n FROM docs_),
kept AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY NOT is_cited, pos) AS position FROM numbered WHERE is_cited OR n <= 3)
SELECT message_id, position, document_id, document_id || '-' || chunk_index AS chunk_id, is_cited FROM kept""", ints=("position",))
def collapsed_citations(spark, sf_dir):
    flagged = cit.flag_cited(cit.first_seen(T.retrieved(spark, sf_dir)), T.answers(spark, sf_dir))
    return cit.select_sources(cit.collapse_by_document(flagged), 3).select(
        "message_id", "position", "document_id", "chunk_id", "is_cited"
    )


@query(T.with_ctes(T.CONVS, T.ANSWERS) + f"""
, firsts AS (SELECT message_id, chunk_id, min(pos) AS pos, any_value(document_id) AS document_id, any_value(chunk_index) AS chunk_index
             FROM retrieved GROUP BY message_id, chunk_id),
flagged AS (SELECT f.*, contains(a.final_text, '[c:' || f.chunk_id || ']') AS is_cited FROM firsts f JOIN answers a USING (message_id)),
docs_ AS (SELECT message_id, document_id, min(pos) AS pos, bool_or(is_cited) AS is_cited,
                 coalesce(min(chunk_index) FILTER (is_cited), min(chunk_index)) AS chunk_index FROM flagged GROUP BY message_id, document_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY message_id, is_cited ORDER BY pos) AS n FROM docs_),
lists AS (SELECT message_id, string_agg(document_id || '-' || chunk_index || CASE WHEN is_cited THEN '*' ELSE '' END, ',' ORDER BY NOT is_cited, pos) AS s
          FROM numbered WHERE is_cited OR n <= 10 GROUP BY message_id)
SELECT a.message_id, regexp_replace(answer, '{MARK}', '', 'g') AS content, a.conv_id % 10 = 0 AS is_refusal,
       CASE WHEN a.conv_id % 10 <> 0 THEN l.s END AS sources FROM answers a LEFT JOIN lists l USING (message_id)""")
def answer_sources(spark, sf_dir):
    out = cit.resolve_citations(T.answers(spark, sf_dir), T.retrieved(spark, sf_dir))
    tagged = F.transform("sources", lambda s: F.concat(s["chunk_id"], F.when(s["is_cited"], F.lit("*")).otherwise("")))
    return out.withColumn("sources", F.array_join(tagged, ","))


# --- turn logs --------------------------------------------------------------------------------

PIECE = 7


def token_rows(spark, sf_dir):
    """Each raw answer as a token log: pieces of seven characters, cut anywhere."""
    pieces = let(F.col("answer"), lambda text: F.transform(
        F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int")),
        lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)),
    ))
    return T.answers(spark, sf_dir).select("message_id", "conv_id", "turn", pieces.alias("pieces")).select(
        "message_id", "conv_id", "turn", F.size("pieces").alias("n"), F.posexplode("pieces").alias("seq", "token")
    )


def frame_rows(spark, sf_dir):
    """The token log as event-stream frames, with status events, errors and end marks between."""
    rows = token_rows(spark, sf_dir)
    data = F.concat(F.lit("data: "), F.expr("substring(to_json(array(token)), 2, length(to_json(array(token))) - 2)"), F.lit("\n\n"))
    status = F.lit('event: status\ndata: {"type": "tool_call_done", "tool": "t"}\n\n')
    other = (
        F.when(F.col("seq") == 0, status).when(F.col("seq") == F.col("n") - 1, F.lit("data: [DONE]\n\n"))
        .when(F.col("seq") % 50 == 10, F.lit(": keepalive\n\n")).when(F.col("seq") % 50 == 20, F.lit('data: {"error": "x"}\n\n'))
    )
    frames = F.filter(F.array(F.struct(F.lit(0).alias("k"), data.alias("f")), F.struct(F.lit(1).alias("k"), other.alias("f"))), lambda x: x["f"].isNotNull())
    return rows.select("message_id", "seq", F.explode(frames).alias("x")).select(
        "message_id", (F.col("seq") * 2 + F.col("x.k")).cast("bigint").alias("seq"), F.col("x.f").alias("frame")
    )


@query(T.with_ctes(T.CONVS, T.ANSWERS) + "SELECT message_id, answer AS text FROM answers")
def answer_text(spark, sf_dir):
    return tc.answer_text(frame_rows(spark, sf_dir))


def _fragments(spark, sf_dir):
    """Every answer's tokens read as argument fragments of tool calls, three calls per round."""
    rows = token_rows(spark, sf_dir)
    n = F.col("seq")
    return rows.select(
        F.col("conv_id").alias("turn_id"), F.col("turn").alias("round"), (n % 3).alias("idx"), n.alias("seq"),
        F.when(n < 3, F.concat("message_id", F.lit("/"), n.cast("string"))).otherwise(F.lit("")).alias("call_id"),
        F.lit(None).cast("string").alias("call_type"),
        F.when(n % 9 < 3, F.concat(F.lit("tool"), F.floor(n / 9).cast("string"))).alias("name"),
        F.col("token").alias("arguments"),
    )


FRAGMENTS = f"""
tokens AS (SELECT message_id, conv_id, turn, i, substr(answer, i * {PIECE} + 1, {PIECE}) AS token
           FROM (SELECT *, unnest(range((length(answer) - 1) // {PIECE} + 1)) AS i FROM answers)),
calls AS (
  SELECT conv_id AS turn_id, turn AS round, CAST(i % 3 AS INTEGER) AS idx, any_value(message_id) || '/' || (i % 3) AS call_id,
         'tool' || max(i // 9) FILTER (i % 9 < 3) AS name, string_agg(token, '' ORDER BY i) AS arguments
  FROM tokens GROUP BY conv_id, turn, i % 3
)"""


@query(T.with_ctes(T.CONVS, T.ANSWERS, FRAGMENTS) + """
SELECT turn_id, round, idx, call_id, 'function' AS call_type, name, arguments FROM calls""")
def assembled_tool_calls(spark, sf_dir):
    return tc.assemble_tool_calls(_fragments(spark, sf_dir))


@query(T.with_ctes(T.CONVS, T.ANSWERS, FRAGMENTS) + """
SELECT turn_id, round, idx, CASE WHEN n <= 6 THEN n END AS call_no, n > 6 AS capped
FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY round, idx) AS n FROM calls)""", ints=("call_no",))
def tool_budget(spark, sf_dir):
    calls = _fragments(spark, sf_dir).select("turn_id", "round", "idx").distinct()
    return tc.cap_tool_calls(calls)


@query(T.with_ctes(T.CONVS, T.ANSWERS, FRAGMENTS) + """
, kinds AS (SELECT conv_id AS turn_id, turn AS round, CASE WHEN turn % 4 = 3 OR i % 2 = 0 THEN 'tool_call' ELSE 'content' END AS kind,
                   CASE WHEN turn % 4 = 3 OR i % 2 = 0 THEN i % 3 END AS idx FROM tokens),
rounds AS (SELECT turn_id, round, count(*) FILTER (kind = 'content') AS content_deltas,
                  count(DISTINCT idx) FILTER (kind = 'tool_call') AS tool_calls_pending FROM kinds GROUP BY turn_id, round)
SELECT *, CAST(coalesce(sum(tool_calls_pending) OVER (PARTITION BY turn_id ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS tool_calls_made,
       content_deltas = 0 AS is_empty FROM rounds""")
def stream_metrics(spark, sf_dir):
    rows = token_rows(spark, sf_dir)
    call = (F.col("turn") % 4 == 3) | (F.col("seq") % 2 == 0)
    deltas = rows.select(
        F.col("conv_id").alias("turn_id"), F.col("turn").alias("round"),
        F.when(call, "tool_call").otherwise("content").alias("kind"), F.when(call, F.col("seq") % 3).alias("idx"),
    )
    return tc.stream_metrics(deltas)
