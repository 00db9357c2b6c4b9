"""Time the headline queries and print one JSON line.

BENCH_SF_DIR selects the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

HEADLINE = [
    "s1_read_pages", "e0_page_text", "e0_page_links", "e1_extract_emails_documents",
    "e2_extract_phones_documents", "e8_extract_contact_person", "e10_extract_contacts",
    "e10_extract_contacts_pages", "p5_relevance", "p6_flag_ecommerce", "p7_flag_blocked_pages",
    "x2_normalize_phone", "x8_is_person_name", "x11_query_slug", "d1_merge_results",
    "d2_first_valid", "d3_dedup_domain", "j2_probe_subpage", "j3_fill_from_pages",
    "j5_check_phone_country", "j7_similar_name_pairs", "d4_dedup_similar_names",
    "d4_dedup_near_copies", "d5_deduplicate", "a1_column_profile", "a5_product_list",
    "s7_append_run", "s8_list_runs", "e11_build_directory", "st1_stream_contacts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from siteroster.registry import entries
    from siteroster.session import build_session

    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry, seconds = entries(), {}
    # one small query first: session start-up is not part of any timing
    registry["e0_page_text"][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    with contextlib.suppress(Exception):
        spark.stop()


if __name__ == "__main__":
    main()
