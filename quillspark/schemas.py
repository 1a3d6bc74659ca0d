"""Declared schemas (as DDL) of the stored tables and of the shapes operators exchange."""

from __future__ import annotations

DOCUMENTS = (
    "document_id string, title string, description string, url string, content_path string, "
    "source_type string, lang string, etag string, last_modified string, content_hash string, "
    "metadata map<string,string>, last_crawled_at timestamp, created_at timestamp, updated_at timestamp"
)

CHUNKS = (
    "chunk_id string, document_id string, content string, chunk_index int, "
    "section_path array<string>, anchor string, char_start int, char_end int, source_type string"
)

CONVERSATIONS = (
    "conversation_id string, user_id string, title string, created_at timestamp, updated_at timestamp"
)

CITATION_DDL = (
    "chunk_id string, content string, document_id string, document_title string, document_url string, "
    "document_content_path string, source_type string, section_path array<string>, anchor string, "
    "chunk_index int"
)

MESSAGES = (
    "message_id string, conversation_id string, role string, content string, "
    f"sources array<struct<{','.join(p.strip().replace(' ', ':', 1) for p in CITATION_DDL.split(', '))},"
    "is_cited:boolean>>, created_at timestamp"
)

SYNC_RUNS = (
    "run_id string, kind string, status string, items_total bigint, items_new bigint, "
    "items_updated bigint, items_unchanged bigint, items_error bigint, started_at timestamp, "
    "finished_at timestamp"
)

SYNC_ITEMS = (
    "item_id string, run_id string, source_ref string, outcome string, error_message string, "
    "created_at timestamp"
)

FEEDBACK = (
    "feedback_id string, message_id string, conversation_id string, suggested_correction string, "
    "payload_json string, issue_url string, status string, created_at timestamp"
)

FETCH_LOG = (
    "url string, content binary, content_type string, etag string, last_modified string, "
    "http_status int, fetch_error string, robots_allowed boolean"
)

HIT_COLUMNS = (
    "query_id", "rank", "chunk_id", "document_id", "document_title", "document_url",
    "document_content_path", "source_type", "content", "section_path", "anchor", "chunk_index",
    "char_start", "char_end", "score",
)

CITATION_COLUMNS = (
    "chunk_id", "content", "document_id", "document_title", "document_url",
    "document_content_path", "source_type", "section_path", "anchor", "chunk_index",
)

SECTION_TYPE = "array<struct<level:int,text:string,char_offset:int,anchor:string>>"

# Values the stored tables may hold (fixed values).
ROLES = ("user", "assistant")
RUN_KINDS = ("url_list", "vault")
RUN_STATUSES = ("running", "completed", "failed")
ITEM_OUTCOMES = ("pending", "ingested", "updated", "unchanged", "error")
