"""Print the executed physical plan of registered queries.

    python -m editrisk.plans.explain /root/testdata/sf0.01 join_frequency cum_unique

Each query is run once (noop sink); the summary line counts, in the
planned (pre-adaptive) physical plan, the exchanges, broadcast and
sort-merge joins and window operators, and lists the pushed filters.  At run
time AQE may still turn a sort-merge join into a broadcast join when the
measured side is small.
"""

from __future__ import annotations

import re
import sys


def summary(plan: str) -> str:
    """Operator counts; a cached plan printed at every use is counted once
    (exchanges are told apart by their plan id)."""
    lines = set(plan.splitlines())

    def n(pat):
        return len({re.sub(r"^[\s:+\-*]*", "", ln) for ln in lines if re.search(pat, ln)})
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""})
    return (f"exchanges={n(r'Exchange (hashpartitioning|rangepartitioning|RoundRobin|SinglePartition)')} "
            f"broadcast_joins={n(r'BroadcastHashJoin')} smj={n(r'SortMergeJoin')} "
            f"windows={n(r'Window \[')} single_partition={n(r'Exchange SinglePartition')} pushed={pushed}")


def main(argv: list[str]) -> None:
    sf = argv[0]
    names = argv[1:]
    from .. import session
    from . import registry
    spark = session.build_session("local[8]", 8)
    registry.load_all()
    for name in names:
        df = registry.QUERIES[name](spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
        print(f"===== {name}: {summary(plan)}")
        df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
