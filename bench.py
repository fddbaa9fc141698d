"""Headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` threads; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Python workers

HEADLINE = [
    "span_prf", "span_prf_by_lang", "seen_form_recall", "vote_threshold_sweep", "run_ranking", "ocr_noise_flags", "stopword_language", "exact_dedup",
    "paragraph_dedup", "minhash_signature", "near_dedup_first_in_bucket", "drop_reason_funnel", "source_quota_cut", "bilou_decode", "token_windows",
    "window_average", "scheme_projection", "token_packing", "gazetteer_grouping_sets", "swap_offset_rewrite",
]


def main() -> None:
    from spanloom.plans import catalog, registry  # noqa: F401
    from spanloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    registry.QUERIES["length_bucket_hist"](spark, sf_dir).collect()  # starts workers and compiles the scan
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
