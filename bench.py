"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full with the no-op sink (every row computed,
nothing collected to the driver) and timed on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wordloom.plans.registry import queries  # noqa: E402
from wordloom.session import build_session  # noqa: E402

HEADLINE = [
    "tokenize", "token_counts", "token_shape", "ngrams_longest_first", "stopword_filter",
    "training_pairs", "labels_to_columns", "first_seen_dedupe",
    "idf_ngrams", "mean_vector", "outlier_word", "ngram_segment", "resolve_entity",
    "nearest_centroid", "kmeans_by_type", "synonym_map", "spell_correct",
    "viterbi_decode", "label_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    qs = queries()
    times = {}
    for name in names:
        t = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
