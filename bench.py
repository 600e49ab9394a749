"""Seconds of the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. What an ingest stores
(chunks, postings, vectors, trigrams, edges) is written first, and told apart."""

import json
import os
import time

from tessera import registry
from tessera.plans import views
from tessera.session import local_session

INGEST = ("chunks", "postings", "terms", "vectors", "edges")
HEADLINE = ("rt05_bm25", "rt01_hybrid_search", "rt08_vector", "rt12_weighted_rrf", "ag14_ir_metrics", "gr07_cooccurrence", "ag17_duplicate_files", "st08_cdc", "tx08_quality", "jn14_asof_prior_user_turn", "ag12_latency_histogram", "st13_sessions")


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    registry.load()
    spark = local_session(cpus, int(cpus), "8g")

    def timed(f) -> float:
        t = time.time()
        f()
        return round(time.time() - t, 3)

    run = lambda name: registry.QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
    run("ag02_status")
    ingest = {name: timed(lambda: getattr(views, name)(spark, d)) for name in INGEST}
    took = {name: timed(lambda: run(name)) for name in HEADLINE}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "ingest": ingest, "sf": d.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
