"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores. Results go to the ``noop`` sink, so every row is computed and
none passes the driver.
"""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from twinscript.catalog import CATALOG  # noqa: E402
from twinscript.session import build_session, drop_stages  # noqa: E402

HEADLINE = [
    "deck_residual_report",
    "script_chars_by_slide",
    "script_chars_total",
    "before_after_by_slide",
    "distinct_sources",
    "missing_sources",
    "lookup_translations",
    "apply_tm_exact",
    "merge_tm",
    "assign_batches",
    "translate_missing",
    "consensus_merge",
    "run_disagreement",
    "normalize_block",
    "normalize_batch",
    "title_case_tagged",
    "replace_banned",
    "mask_fragile",
    "length_policy",
    "content_integrity",
    "glossary_missing",
    "glossary_hits_large_table",
    "banned_word_matches",
    "term_variants",
    "bullet_groups",
    "style_diagnostics",
    "apply_diagnostics",
    "all_issues",
    "quality_gate",
    "deck_audit",
    "extract_paragraphs",
    "extract_text_blocks",
    "sample_first_blocks",
    "token_totals",
    "deck_cost_report",
]

# The operations the published overhead per slide is about.
STYLE = ["normalize_block", "normalize_batch", "title_case_tagged", "replace_banned", "apply_diagnostics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(CATALOG)
    shared = tempfile.mkdtemp(prefix="bench-")
    spark = build_session(
        "bench",
        f"local[{cores}]",
        **{"spark.sql.shuffle.partitions": cores, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.checkpoint.dir": shared},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first queries would pay for starting the engine.
    for name in ("deck_residual_report", "title_case_tagged", "lookup_translations"):
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        drop_stages(spark)
    slides = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "slides": slides,
                "ms_per_slide": {n: round(seconds[n] * 1000 / slides, 3) for n in STYLE if n in seconds},
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
