"""Measure the headline queries: seconds, shuffle bytes and exchanges, as a Markdown table.

    python tests/baseline.py [folder] [runs] > table.md

Passes over all queries, so that a slow minute of the machine does not fall on one query alone; the first
pass warms up.  The table is printed after every pass, the last one counts.
"""

from __future__ import annotations

import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from bench import HEADLINE  # noqa: E402
from placemetrics.queries.catalogue import QUERIES  # noqa: E402
from placemetrics.session import build_session  # noqa: E402


def main() -> None:
    folder, runs = (sys.argv[1:] + ["/root/testdata/sf0.1", "5"][len(sys.argv) - 1:])[:2]
    spark = build_session("local[8]", 8, "placemetrics-baseline", **{"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")

    def written() -> int:
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(k).totalShuffleWrite() for k in range(executors.size()))

    seconds: dict[str, list[float]] = {name: [] for name in HEADLINE}
    shuffled, exchanges = {}, {}
    for number in range(int(runs) + 1):
        for name in HEADLINE:
            before, start = written(), time.perf_counter()
            df = QUERIES[name](spark, folder)
            df.write.format("noop").mode("overwrite").save()
            seconds[name].append(time.perf_counter() - start)
            shuffled[name] = written() - before
            plan = df._jdf.queryExecution().executedPlan().toString()
            exchanges[name] = plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count(
                "Exchange SinglePartition") + plan.count("Exchange RoundRobin")
        if number:
            warm = {name: statistics.median(times[1:]) for name, times in seconds.items()}
            print(f"\nMedian of {number} warm runs, {Path(folder).name}, local[8]; {sum(warm.values()):.1f} s together\n")
            print("| query | s | shuffle, KB | exchanges of the last step |\n| --- | --- | --- | --- |")
            for name in HEADLINE:
                print(f"| {name} | {warm[name]:.2f} | {shuffled[name] / 1000:.0f} | {exchanges[name]} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
