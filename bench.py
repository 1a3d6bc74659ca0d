"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "line_chunks", "sections", "token_chunks", "chunk_offsets", "page_markdown", "bm25_stats", "embedded_chunks",
    "keyword_topk", "keyword_topk_allowed", "semantic_topk", "vector_topk_by_label", "hybrid_rrf_topk",
    "search_text", "hybrid_search_text", "hybrid_answers", "rendered_documents", "documents_with_counts", "ingest_outcomes",
    "snapshot_after_sync", "markdown_vault", "migrated_chunks", "conversation_list", "question_answer_pairs",
    "conversation_markdown", "answer_sources", "feedback_reports", "answer_text", "assembled_tool_calls",
)


def main() -> None:
    from quillspark import plans
    from quillspark.plans.retrieval import corpus_index
    from quillspark.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus,
        "spark.quillspark.spreadFiles": "true",  # each table is one file here
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.all_queries()
    times: dict[str, float] = {}
    spark.range(1_000_000).selectExpr("sum(id)").collect()  # start the executors before timing

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    timed("index_build", lambda: corpus_index(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
