"""List plan shapes that would not scale: ``python tests/plans.py [sf] [name-prefix…]``."""

from __future__ import annotations

import re
import sys

from oracle import session

BAD = {
    "cartesian": r"CartesianProduct",
    "nested loop": r"BroadcastNestedLoopJoin",
    "python": r"ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas|MapInPandas|PythonMapInArrow",
    "single task": r"Exchange SinglePartition",
    "window without key": r"Window \[[^\n]*\], \[\]|Window \[[^\n]*windowspecdefinition\((?:0|[a-z_]+#\d+ (?:ASC|DESC))",
}


def findings(df) -> dict[str, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name: len(re.findall(pattern, plan)) for name, pattern in BAD.items() if re.search(pattern, plan)}


if __name__ == "__main__":
    from __spark_entry__ import queries

    scale, wanted = (sys.argv[1] if len(sys.argv) > 1 else "0.001"), sys.argv[2:]
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        found = findings(fn(spark, f"/root/testdata/sf{scale}"))
        if found:
            print(name, found, flush=True)
