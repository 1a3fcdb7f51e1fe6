"""Headline queries, timed: one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the threads."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "pii_findings", "secret_findings", "log_auth_events", "cim_summary", "indicators_per_doc", "hash_ioc_matches", "domain_ioc_matches", "typosquat_domains", "hotspots",
    "web_links", "report_sarif", "container_closure", "gc_live_set", "rank_by_value", "confidence_budget", "recall_at_budget",
)


def quality(spark) -> dict:
    """Ranking of held-out paths of a made-up tree: 320 paths, 0.3 of them held out; findings lie in some folders and kinds of file."""
    from siftstone.model import classifier

    kinds = (("config/secrets", "env", True), ("deploy/keys", "pem", True), ("src/app", "py", False), ("docs/guide", "md", False), ("web/static", "js", False), ("test/data", "txt", False), ("lib/core", "rs", False), ("assets/img", "svg", False))
    rows = [(f"/srv/team{i % 5}/{folder}/part{i % 11}/file{i}.{end}", has and i % 9 != 0) for i in range(40) for folder, end, has in kinds]
    found = classifier.evaluate(spark.createDataFrame(rows, "path string, has_finding boolean"), states=4, rounds=10)
    recall = {f"{p['budget']:.2f}": {"model": round(p["model"], 3), "directory_prior": round(p["baseline"], 3)} for p in found["points"]}
    return {"recall_at_budget": recall, "mean_lift": round(found["mean_lift"], 2), "brier": round(found["brier"], 4), "ece": round(found["ece"], 4)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    os.environ["PYTHONPATH"] = f"{root}:{os.environ.get('PYTHONPATH', '')}"
    from siftstone.session import local_session

    spark = local_session(cpus, "8g", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    from siftstone.plans import catalog

    queries = catalog.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run(HEADLINE[0])  # start-up and code generation
    times = {}
    for name in HEADLINE:
        began = time.time()
        run(name)
        times[name] = round(time.time() - began, 3)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {"documents_per_sec_pii": round(documents / times["pii_findings"]), "documents_per_sec_indicators": round(documents / times["indicators_per_doc"])}
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": rates, "ranking": quality(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
