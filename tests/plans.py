"""Lists plan hazards of the catalogue's queries.

    python tests/plans.py [name ...]
"""

from __future__ import annotations

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

HAZARDS = ["CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython",
           "MapInPandas", "FlatMapGroupsInPandas"]

def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def hazards(plan: str) -> list[str]:
    return [h for h in HAZARDS if h in plan]


def main() -> None:
    from lodestone.plans.registry import load, runner
    from lodestone.session import build_session

    folder = "/root/testdata/sf0.001"
    spark = build_session("plans", "8")
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[1:] or load():
        plan = plan_of(runner(name)(spark, folder))
        print(name, hazards(plan) or "clean", "exchanges", plan.count("Exchange hashpartitioning"),
              "broadcasts", plan.count("BroadcastExchange"), flush=True)


if __name__ == "__main__":
    main()
