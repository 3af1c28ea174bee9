"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts.  The whole query
is timed, from building it to writing its rows to the no-op sink.  With BENCH_DUCKDB=1 the same
SQL is timed on DuckDB with as many threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gradeflow.session import get_session  # noqa: E402
from registry.oracles import ORACLES  # noqa: E402
from registry.spark_queries import QUERIES  # noqa: E402

HEADLINE = {
    "score_report": "labels",
    "oof_predictions": "labels",
    "compose_prompt": "documents",
    "pair_rows": "labels",
    "assign_batches": "documents",
    "token_counts": "documents",
    "encode_tokens": "documents",
    "spell_candidates": "documents",
    "correct_spelling": "documents",
    "extractive_summary": "documents",
    "pool_gem": "embeddings",
    "running_meter": "events",
    "logo_ridge": "labels",
    "predict_ensemble": "documents",
    "batch_scoring": "embeddings",
    "stream_score": "documents",
}


def median_seconds(run, runs: int) -> float:
    times = []
    for _ in range(runs):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return statistics.median(times)


def duckdb_seconds(sf_dir: str, cpus: int, names: list[str], runs: int) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": cpus})
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return {
        name: round(median_seconds(lambda n=name: con.execute(ORACLES[n]).fetchall(), runs), 3)
        for name in names
        if name in ORACLES
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = get_session(
        "gradeflow-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=str(cpus),
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, throughput = {}, {}
    for name in names:
        def run(query=QUERIES[name]):
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()

        run()
        seconds[name] = round(median_seconds(run, runs), 3)
        rows = spark.read.parquet(f"{sf_dir}/{HEADLINE.get(name, 'documents')}.parquet").count()
        throughput[name] = round(rows / seconds[name])
    line = {
        "metric": "total median seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
        "cpus": cpus,
        "rows_per_second": throughput,
    }
    if os.environ.get("BENCH_DUCKDB"):
        line["duckdb"] = duckdb_seconds(sf_dir, cpus, names, runs)
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
