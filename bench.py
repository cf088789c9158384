"""Headline queries on one machine: prints one JSON line with seconds per query.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (cores of local mode).
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "st4_page_links",
    "st9_page_assets",
    "st11_page_context",
    "j3_page_liveness",
    "t1_fingerprints",
    "t2_hosts",
    "t4_marketing_signals",
    "t9_tech_profile",
    "t11_target_evidence",
    "c1_email_candidates",
    "c3_best_email",
    "c7_contact_cascade",
    "st8_jsonld_nodes",
    "x2_schema_facts",
    "x7_confidence",
    "w1_first_per_domain",
    "l3_post_process_queries",
    "q1_q5_read_prompts",
    "q7_generate_queries",
    "s3_relax_levels",
    "e1_fast_leads",
    "e2_precise_leads",
    "e3_site_audit",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from sitegrain.session import local_session
    from workload import registry

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries = registry.queries()
    pages = spark.read.parquet(f"{folder}/pages.parquet").count()
    seconds = {}
    for name in HEADLINE:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, second run each",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "pages": pages,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
