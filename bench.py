"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from asklens import plans  # noqa: E402
from asklens.session import build_session  # noqa: E402

HEADLINE = [
    "u2_compare_results", "u3_count_difference", "u2_a3_execution_accuracy",
    "a3_stats_by_database", "a4_stats_rollup", "a7_report_times", "a8_report_generation", "a13_report_cube",
    "f6_sql_skeletons", "f7_token_frequencies", "a14_template_counts", "j4_query_lineage",
    "j5_cosine_join", "w1_top_n", "w2_knn_exact", "w3_knn_cells", "w4_knn_lsh", "w5_edit_top_n",
    "u1_merge_examples", "w6_split_pairs", "f1_clean_answers", "f2_extract_json", "f3_notes_struct",
    "f8_question_skeletons", "j7_linking_scores",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    plans.load_all()
    # Start-up of the engine and its Python workers is not part of any query.
    spark.range(1000).mapInPandas(lambda it: it, "id long").write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
