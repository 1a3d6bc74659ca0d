import pytest
from pyspark.sql import functions as F

from quillspark.operators import ingest
from quillspark.schemas import DOCUMENTS, FETCH_LOG
from quillspark.session import new_work_dir
from quillspark.sources import legacy
from quillspark.sources.store import CorpusStore
from quillspark.sources.url_list import read_url_list
from quillspark.sources.vault import read_vault
from quillspark.streaming.frames import event_stream
from quillspark.streaming.markers import cut_markers, strip_stream
from quillspark.streaming.sync import drain, sync_stream

PAGE = b"<html lang='en'><head><title>T</title></head><body><h1>Head</h1><p>Body text of the page.</p></body></html>"


def log(spark, *rows):
    full = [(u, c, ct, e, None, st, err, rb) for u, c, ct, e, st, err, rb in rows]
    return spark.createDataFrame([(u, bytearray(c) if c is not None else None, *r) for u, c, *r in full], FETCH_LOG)


def page(url, content=PAGE, content_type="text/html", etag=None, status=200, error=None, robots=True):
    return (url, content, content_type, etag, status, error, robots)


def documents(spark, *rows):
    """Rows of (document_id, url, content_path, content_hash)."""
    full = [(i, f"old {i}", "", u, p, "docs", "de", f"e-{i}", None, h, {}, None, None, None) for i, u, p, h in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def outcomes(staged):
    return {r["source_ref"]: (r["outcome"], r["error_message"]) for r in staged.collect()}


def test_url_list(spark, tmp_path):
    (tmp_path / "list.md").write_text(
        "# Notes: https://example.com/skipped\n\n[A](https://example.com/a) and [B](https://example.com/b)\n"
        "See https://example.com/page.\n- https://example.com/a\n   # https://example.com/no\n\"http://x.org/q?a=1\";\n")
    rows = read_url_list(spark, str(tmp_path / "list.md")).orderBy("line_no", "pos").collect()
    assert [r["url"] for r in rows] == ["https://example.com/a", "https://example.com/b", "https://example.com/page", "http://x.org/q?a=1"]


def test_fetch_status(spark):
    df = log(spark, page("https://a"), page("https://b", None, status=304), page("https://c", None, status=404), page("https://d", None, status=500),
             page("ftp://e"), page("https://f", robots=False), page("https://g", None, status=None, error="timed out"))
    got = {r["url"]: (r["status"], r["error"]) for r in ingest.classify_fetch(df).collect()}
    assert got == {
        "https://a": ("ok", None), "https://b": ("not_modified", None), "https://c": ("error", "HTTP 404"), "https://d": ("error", "HTTP 500"),
        "ftp://e": ("error", "invalid_scheme"), "https://f": ("skipped_robots", None), "https://g": ("error", "timed out")}


def test_page_outcomes_in_order(spark):
    import hashlib

    digest = hashlib.sha256(PAGE).hexdigest()
    stored = documents(spark, ("p1", "https://same", None, digest), ("p2", "https://changed", None, "old"), ("p3", "https://304", None, "old"))
    df = log(
        spark, page("https://new"), page("https://same"), page("https://changed"), page("https://304", None, status=304),
        page("https://404", None, status=404), page("https://robots", robots=False), page("https://none", None), page("https://empty", b""),
        page("https://blank", b"<html><nav>menu</nav></html>"), page("https://heads", b"<h1>Only a heading</h1>"),
        page("https://pdf", b"%PDF-1.4 x", None), page("https://md", b"# Mark\n\ndown", "text/markdown"))
    staged = ingest.stage_pages(df, stored, "docs")
    no_body = "extractor yielded no body (possibly JS-rendered or empty page)"
    assert outcomes(staged) == {
        "https://new": ("ingested", None), "https://same": ("unchanged", None), "https://changed": ("updated", None), "https://304": ("unchanged", None),
        "https://404": ("error", "fetch failed: HTTP 404"), "https://robots": ("error", "skipped by robots.txt"),
        "https://none": ("error", "crawler returned OK with empty body"), "https://empty": ("error", no_body), "https://blank": ("error", no_body),
        "https://heads": ("error", "chunker produced 0 chunks"), "https://pdf": ("error", no_body), "https://md": ("ingested", None)}
    summary = ingest.run_summary(ingest.sync_items(staged, F.lit("r"), F.lit(None).cast("timestamp"))).first().asDict()
    assert summary == {"run_id": "r", "items_total": 12, "items_new": 2, "items_updated": 1, "items_unchanged": 2, "items_error": 7}
    titles = {r["source_ref"]: r["title"] for r in staged.collect()}
    assert titles["https://md"] == "Mark" and titles["https://new"] == "T" and titles["https://304"] == "old p3"


def test_merge_keeps_what_the_run_does_not_say(spark):
    stored = documents(spark, ("p1", "https://a", None, "old"), ("p2", "https://gone", None, "h"), ("p3", "https://err", None, "h"))
    staged = ingest.stage_pages(log(spark, page("https://a"), page("https://n", etag="e9"), page("https://err", None, status=500)), stored, "docs")
    merged = {r["url"]: r for r in ingest.merge_documents(stored, staged, F.lit("2024-01-01").cast("timestamp")).collect()}
    assert set(merged) == {"https://a", "https://gone", "https://err", "https://n"}
    a, new = merged["https://a"], merged["https://n"]
    assert (a["title"], a["etag"], a["lang"], a["document_id"]) == ("T", "e-p1", "de", "p1") and a["content_hash"] != "old"
    assert (new["description"], new["metadata"], new["etag"], new["source_type"]) == ("", {}, "e9", "docs")
    assert merged["https://gone"]["updated_at"] is None and merged["https://err"]["updated_at"] is None and a["updated_at"] is not None


def test_clear_and_duplicates_and_replace(spark):
    stored = documents(spark, ("p1", "https://a", None, "h"), ("p2", None, "b.md", "h"))
    cleared = {r["document_id"]: r for r in ingest.clear_crawl_state(stored, stored.where("document_id = 'p1'"), F.current_timestamp()).collect()}
    assert cleared["p1"]["content_hash"] is None and cleared["p1"]["etag"] is None and cleared["p2"]["content_hash"] == "h"
    fine, clash = ingest.reject_duplicate_keys(documents(spark, ("n1", "https://a", None, ""), ("n2", None, "b.md", ""), ("n3", None, None, "")), stored)
    assert [r["document_id"] for r in fine.collect()] == ["n3"]
    assert {r["document_id"]: r["reason"] for r in clash.collect()} == {"n1": "duplicate url", "n2": "duplicate content_path"}
    old = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "document_id string, n int")
    new = spark.createDataFrame([("a", 9)], "document_id string, n int")
    assert sorted(tuple(r) for r in ingest.replace_rows(old, new, new).collect()) == [("a", 9), ("b", 1)]


def test_first_of_incoming_duplicates_is_kept(spark):
    incoming = documents(spark, ("n2", "https://x", None, ""), ("n1", "https://x", None, ""), ("n3", None, "c.md", ""), ("n4", "https://y", "c.md", ""), ("n5", None, None, ""))
    fine, clash = ingest.reject_duplicate_keys(incoming, documents(spark))
    assert sorted(r["document_id"] for r in fine.collect()) == ["n1", "n3", "n5"]
    assert {r["document_id"]: r["reason"] for r in clash.collect()} == {"n2": "duplicate url", "n4": "duplicate content_path"}


def test_a_url_that_is_fetched_twice_is_one_item(spark):
    fetches = log(spark, page("https://a", status=500, error="timeout"), page("https://a"), page("https://b")).withColumn(
        "fetched_at", F.when(F.col("http_status") == 500, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("timestamp"))
    staged = ingest.stage_pages(fetches, documents(spark), "docs")
    assert {r["url"]: r["outcome"] for r in staged.collect()} == {"https://a": "error", "https://b": "ingested"}
    untimed = ingest.stage_pages(fetches.drop("fetched_at"), documents(spark), "docs")
    assert {r["url"]: r["outcome"] for r in untimed.collect()} == {"https://a": "ingested", "https://b": "ingested"}
    assert [tuple(r) for r in ingest.superseded_fetches(fetches).collect()] == [("https://a", 1)]
    chunks = ingest.staged_chunk_rows(untimed)
    assert chunks.count() == chunks.select("chunk_id").distinct().count() == 2


def test_repeated_incoming_keys(spark):
    old = spark.createDataFrame([("a", 1)], "key string, n int")
    new = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4), ("a", 5)], "key string, n int")
    assert sorted(tuple(r) for r in legacy.insert_or_ignore(old, new, "key", "n").collect()) == [("a", 1), ("b", 3)]
    assert sorted(tuple(r) for r in legacy.insert_or_replace(old, new, "key", "n").collect()) == [("a", 5), ("b", 4)]


def write_vault(root):
    (root / "sub dir").mkdir(parents=True)
    (root / "a.md").write_text('---\ntitle: "Note A"\ndescription: about a\nlang: en\nsource: https://e.com/1\nempty:\n---\n\n# Head\nbody a\n')
    (root / "sub dir" / "b+1.md").write_text("---\nsource: https://e.com/1\ntags:\n  - x\n---\nbody b\n")
    (root / "plain.md").write_text("no front matter\n\n---\n\nrest")
    (root / "blank.md").write_text("---\ntitle: x\n---\n   \n")
    (root / "skip.txt").write_text("not markdown")


def test_vault(spark, tmp_path):
    write_vault(tmp_path)
    notes = {r["content_path"]: r for r in read_vault(spark, str(tmp_path)).collect()}
    assert set(notes) == {"a.md", "sub dir/b+1.md", "plain.md", "blank.md"}
    assert notes["a.md"]["metadata"] == {"title": "Note A", "description": "about a", "lang": "en", "source": "https://e.com/1", "empty": ""}
    assert notes["a.md"]["body"] == "# Head\nbody a" and notes["plain.md"]["body"] == "no front matter\n\n---\n\nrest"
    nested = {r["content_path"]: r["metadata"] for r in read_vault(spark, str(tmp_path), nested=True).collect()}
    assert nested["sub dir/b+1.md"] == {"source": "https://e.com/1", "tags": '["x"]'}
    staged = ingest.stage_vault(read_vault(spark, str(tmp_path)), documents(spark), "vault")
    assert outcomes(staged) == {
        "a.md": ("ingested", None), "sub dir/b+1.md": ("error", "duplicate url"), "plain.md": ("ingested", None), "blank.md": ("error", "empty body")}
    titles = {r["source_ref"]: r["title"] for r in staged.collect()}
    assert titles["a.md"] == "Note A" and titles["plain.md"] == "plain"


def test_store_runs(spark, tmp_path):
    store = CorpusStore(spark, new_work_dir(spark, "store"))
    assert store.version() is None and store.documents().count() == 0 and store.chunks() is None
    other = PAGE.replace(b"Body text", b"Changed text")
    first = store.sync_pages(log(spark, page("https://a"), page("https://b"), page("https://c", None, status=404)), "r1", "2024-01-01 00:00:00").first()
    assert (first["items_total"], first["items_new"], first["items_error"], first["status"]) == (3, 2, 1, "completed")
    ids = {r["url"]: r["document_id"] for r in store.documents().collect()}
    second = store.sync_pages(log(spark, page("https://a", other), page("https://b")), "r2", "2024-01-02 00:00:00").first()
    assert (second["items_updated"], second["items_unchanged"]) == (1, 1)
    text = {r["document_url"]: r["content"] for r in store.chunks().collect()}
    assert text == {"https://a": "Head\nChanged text of the page.", "https://b": "Head\nBody text of the page."}
    assert {r["url"]: r["document_id"] for r in store.documents().collect()} == ids
    assert store.vectors().count() == 2 and store.runs().count() == 2 and store.items().count() == 5
    # A run that is applied again changes nothing.
    store.sync_pages(log(spark, page("https://z")), "r2", "2024-01-03 00:00:00")
    assert store.version() == 1 and store.documents().count() == 2
    # An unfinished version is invisible.
    spark.range(1).write.parquet(f"{store.root}/v=2/documents")
    assert store.version() == 1
    write_vault(tmp_path)
    vault = store.sync_vault(read_vault(spark, str(tmp_path)), "v1", "2024-01-04 00:00:00").first()
    assert (vault["items_new"], vault["items_error"], vault["kind"]) == (2, 2, "vault")
    assert store.documents().count() == 4
    empty = store.sync_pages(log(spark), "r3", "2024-01-05 00:00:00").first()
    assert empty["items_total"] == 0 and store.documents().count() == 4


def test_migration(spark):
    docs = spark.createDataFrame([("1", "Old", '{"k": "v"}', "2024-01-01T00:00:00+00:00"), ("2", None, None, None)],
                                 "document_id string, title string, metadata string, created_at string")
    chunks = spark.createDataFrame([("c1", "1", "t", "[1.5, 2]", '["A","B"]', 3), ("c2", "9", None, None, None, None)],
                                   "chunk_id string, document_id string, content string, embedding string, section_path string, chunk_index int")
    stored = documents(spark, ("1", "https://a", None, "h"))
    now = legacy.legacy_chunks(chunks).drop("embedding").limit(0)
    new_docs, new_chunks, counts = legacy.migrate(stored, now, docs, chunks)
    assert {r["document_id"]: (r["title"], r["metadata"]) for r in new_docs.collect()} == {"1": ("old 1", {}), "2": ("", {})}
    assert {r["chunk_id"]: (r["content"], r["section_path"], r["chunk_index"], r["source_type"]) for r in new_chunks.collect()} == {
        "c1": ("t", ["A", "B"], 3, "docs"), "c2": ("", [], 0, "docs")}
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"documents_inserted": 1, "chunks_written": 2, "vectors_written": 1}
    assert legacy.migrate(stored, now, docs, chunks, dry_run=True)[:2] == (None, None)
    rows = {r["chunk_id"]: r for r in legacy.index_rows(legacy.legacy_chunks(chunks), legacy.legacy_documents(docs)).collect()}
    assert rows["c1"]["document_title"] == "Old" and rows["c1"]["embedding"] == [1.5, 2.0] and rows["c2"]["document_title"] == ""


# --- streams ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("cut", [1, 2, 3, 5, 100])
@pytest.mark.parametrize("tokens", [1, 3, 50])
def test_cutting_equals_stripping_the_whole(cut, tokens):
    import re

    text = "a [c:x-1] b[[c:y] [c: no [c:z_9][d] end [c"
    pieces = [text[i:i + cut] for i in range(0, len(text), cut)]
    out, held = "", ""
    for i in range(0, len(pieces), tokens):
        parts, held = cut_markers(held, pieces[i:i + tokens], final=i + tokens >= len(pieces))
        assert len(parts) == len(pieces[i:i + tokens])
        out += "".join(parts)
    assert out + held == re.sub(r"\[c:[A-Za-z0-9_-]+\]", "", text) and held == ""


def test_cut_text_stays_with_its_token():
    assert cut_markers("x[c:", ["a]y", "", "z[c:b]", "w["], False) == (["xy", "", "z", "w"], "[")
    assert cut_markers("", ["[c:" + "x" * 200], False) == (["[c:" + "x" * 200], "")
    assert cut_markers("[c:", ["", "q"], True) == (["[c:", "q"], "")


def as_stream(spark, df, label):
    path = new_work_dir(spark, label)
    for n in range(3):
        df.where(f"part = {n}").drop("part").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_marker_stream_keeps_state_between_batches(spark):
    rows = [("m", 0, "He[", False, 0), ("m", 1, "c:a", False, 0), ("n", 0, "x [c:", False, 0), ("m", 2, "1]llo [c", False, 1), ("m", 3, "", True, 2), ("n", 1, "q] y", True, 2)]
    df = spark.createDataFrame(rows, "message_id string, seq bigint, token string, is_end boolean, part int")
    out = drain(strip_stream(as_stream(spark, df, "tokens")), "out").orderBy("message_id", "seq").collect()
    text = {}
    for r in out:
        text[r["message_id"]] = text.get(r["message_id"], "") + r["text"]
    assert text == {"m": "Hello [c", "n": "x  y"}


def test_event_stream(spark):
    raw = 'data: "a"\n\nevent: sources\ndata: []\n\n\n\ndata: [DONE]\n\ndata: "tail'
    rows = [("m", i, raw[i * 4:i * 4 + 4], min(2, i // 6)) for i in range(-(-len(raw) // 4))]
    df = spark.createDataFrame(rows, "message_id string, seq bigint, piece string, part int")
    out = drain(event_stream(as_stream(spark, df, "pieces")), "blocks").orderBy("block_no").collect()
    assert [(r["kind"], r["text"]) for r in out] == [("token", "a"), ("sources", None), ("done", None)]


def test_delete_and_second_writer(spark):
    store = CorpusStore(spark, new_work_dir(spark, "store"))
    store.sync_pages(log(spark, page("https://a"), page("https://b")), "one", "2024-01-01 00:00:00")
    ids = store.documents().where("url = 'https://a'").select("document_id")
    run = store.delete_documents(ids, "two", "2024-01-02 00:00:00").collect()[0]
    assert (run["kind"], run["items_total"]) == ("delete", 1)
    assert [r["url"] for r in store.documents().collect()] == ["https://b"]
    assert {r["document_url"] for r in store.chunks().collect()} == {"https://b"} and store.vectors().count() == store.chunks().count()
    store.delete_documents(ids, "two", "2024-01-03 00:00:00")  # applied once
    assert store.version() == 1
    with store._writing():
        with pytest.raises(RuntimeError, match="has a writer"):
            store.sync_pages(log(spark, page("https://c")), "three", "2024-01-01 00:00:00")
    store.sync_pages(log(spark, page("https://a"), page("https://b")), "three", "2024-01-04 00:00:00")
    assert {r["document_url"] for r in store.chunks().collect()} == {"https://a", "https://b"}


def test_two_streams_into_one_store(spark):
    store = CorpusStore(spark, new_work_dir(spark, "store"))
    for url in ("https://a", "https://b"):
        rows = log(spark, page(url)).withColumn("part", F.lit(0))
        sync_stream(as_stream(spark, rows, "fetch"), store, new_work_dir(spark, "checkpoint"), lambda n: "2024-01-01 00:00:00")
    assert {r["url"] for r in store.documents().collect()} == {"https://a", "https://b"}
    assert len({r["run_id"] for r in store.runs().collect()}) == store.runs().count()


def test_sync_stream(spark):
    store = CorpusStore(spark, new_work_dir(spark, "store"))
    parts = [page("https://a"), page("https://b"), page("https://a", PAGE.replace(b"Body", b"New"))]
    rows = [log(spark, p).withColumn("part", F.lit(n)) for n, p in enumerate(parts)]
    df = rows[0].unionByName(rows[1]).unionByName(rows[2])
    stream = as_stream(spark, df, "fetch")
    checkpoint = new_work_dir(spark, "checkpoint")
    for _ in range(2):  # the second start finds nothing new
        sync_stream(stream, store, checkpoint, lambda n: "2024-01-01 00:00:00")
    assert store.version() == 2 and store.runs().count() == 3
    assert {r["document_url"]: r["content"] for r in store.chunks().collect()} == {
        "https://a": "Head\nNew text of the page.", "https://b": "Head\nBody text of the page."}


def test_a_message_that_never_ends_gives_its_tail():
    import pandas as pd

    from quillspark.streaming.frames import _split_group

    class State:
        exists, hasTimedOut, get, timer = False, False, None, None

        def update(self, value):
            self.exists, self.get = True, value

        def remove(self):
            self.exists, self.get = False, None

        def setTimeoutDuration(self, ms):
            self.timer = ms

    state, split = State(), _split_group(500)
    pieces = pd.DataFrame({"seq": [1, 0], "piece": ["b\n\nda", "data: a"]})
    [out] = split(("m",), iter([pieces]), state)
    assert out["raw"].tolist() == ["data: ab"] and state.get == ("da", 1) and state.timer == 500
    state.hasTimedOut = True
    [out] = split(("m",), iter([]), state)
    assert list(zip(out["block_no"], out["raw"])) == [(1, "da")] and not state.exists
