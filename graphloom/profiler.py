"""What queries ask for, and what layout would serve them; hooks around runs."""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from .plans.query import Query

#: Uses of a property from which a layout is recommended, and from which strongly.
LEAST_USES, MANY_USES = 3, 10


@dataclass
class Profiler:
    """Counts, by kind and property, how queries filter, order, group and traverse."""

    uses: Counter = field(default_factory=Counter)

    def observe(self, q: Query) -> None:
        kind_of = {q.start[1]: q.start[0]} | {h.alias: h.kind for h in q.hops}
        for alias, fn in q.wheres:
            column, searches = q._predicates(alias)
            kind = kind_of.get(alias) or next("|".join(h.edges) for h in q.hops if h.edge_alias == alias)
            for name in set(re.findall(r"p__(\w+)", str(column))):
                self.uses[kind, name, "filter"] += 1
            for s in searches:
                self.uses[kind, s.field or "*", s.kind] += 1
        for o in q.orders:
            if o.alias:
                self.uses[kind_of.get(o.alias, o.alias), o.name, "order"] += 1
        for a, n in q.keys:
            self.uses[kind_of.get(a, a), n, "group"] += 1
        for h in q.hops:
            for e in h.edges:
                self.uses[e, "from_id" if h.direction == "out" else "to_id", "traverse"] += 1

    def recommendations(self) -> list[dict[str, Any]]:
        """Layouts for Spark: sorting within files for filters and orders, bucketing for joins."""
        out = []
        for (kind, name, use), n in sorted(self.uses.items()):
            if n >= LEAST_USES:
                how = {"traverse": "bucket or sort by", "filter": "sort within files by", "order": "sort within files by", "group": "bucket by", "vector": "keep as array<float>:", "fulltext": "precompute tokens of"}[use]
                out.append({"kind": kind, "property": name, "use": use, "count": n, "advice": f"{how} {name}", "priority": "high" if n >= MANY_USES else "low"})
        return out


@dataclass
class Hooks:
    on_query: list[Callable[[Query], None]] = field(default_factory=list)
    on_done: list[Callable[[Query, float], None]] = field(default_factory=list)
    on_error: list[Callable[[Query, Exception], None]] = field(default_factory=list)

    def run(self, q: Query, **parameters: Any) -> list[Any]:
        for h in self.on_query:
            h(q)
        began = time.monotonic()
        try:
            out = q.execute(**parameters)
        except Exception as e:
            for h in self.on_error:
                h(q, e)
            raise
        for h in self.on_done:
            h(q, time.monotonic() - began)
        return out


def plan_nodes(df: DataFrame) -> Counter:
    """Operators of the physical plan, counted."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    return Counter(re.findall(r"[+:]- (?:\*\(\d+\) )?(\w+)", text))
