"""Truth maintenance: what is believed, given which sources are retracted.

Frames: sources (id, retracted), justifications (id), premises (justification, premise: a source or fact id) and
derives (justification, fact). A justification fires if all its premises are available sources or supported facts; the least
fixpoint is computed round by round from counts of satisfied premises, so cycles don't support themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Growing, forget, materialize


@dataclass
class Provenance:
    sources: DataFrame  # id string, retracted boolean (null: available), deleted boolean optional
    premises: DataFrame  # justification string, premise string
    derives: DataFrame  # justification string, fact string
    facts: DataFrame | None = None  # id, deleted boolean: facts whose rows are gone aren't believed

    def holding(self, retracted: DataFrame | None = None, restored: DataFrame | None = None) -> DataFrame:
        """id of the supported facts. ``retracted`` and ``restored``: ids of sources taken as such."""
        gone = F.coalesce(F.col("retracted"), F.lit(False))
        rows = self.sources.select("id", gone.alias("gone"), (F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in self.sources.columns else F.lit(False)).alias("deleted"))
        for ids, value in ((retracted, True), (restored, False)):
            if ids is not None:
                mark = ids.select("id").distinct().withColumn("__mark", F.lit(value))
                rows = rows.join(mark, "id", "left").withColumn("gone", F.coalesce("__mark", "gone")).drop("__mark")
        spark = rows.sparkSession
        known = materialize(rows.where("not gone and not deleted").select("id").distinct(), "known")
        derives = self.derives.select("justification", "fact").where("justification is not null")
        lacks = self.premises.select("justification", "premise").join(known.withColumnRenamed("id", "premise"), "premise", "left_anti")
        lacking = materialize(lacks.select("premise").distinct(), "lacking")
        later = materialize(derives.select(F.col("fact").alias("premise")).join(lacking, "premise", "left_semi").distinct(), "later").withColumn("fact", F.lit(True))
        # What lacks nothing fires at once; what lacks a premise that no justification derives never does. Rounds are about the rest alone.
        short = lacks.join(later, "premise", "left").groupBy("justification").agg(F.bool_and(F.coalesce("fact", F.lit(False))).alias("waits"))
        short = materialize(short, "short")
        waits = materialize(short.where("waits").select("justification"), "waits")
        believed = Growing(spark, "believed")
        fresh = believed.append(derives.join(short.select("justification"), "justification", "left_anti").select(F.col("fact").alias("id")).distinct())
        pairs = materialize(lacks.join(waits, "justification", "left_semi").select("justification", "premise").distinct(), "premises")
        derives = materialize(derives.join(waits, "justification", "left_semi").distinct(), "derives")
        need = materialize(pairs.groupBy("justification").agg(F.count("*").alias("need")), "need")
        # Semi-naive: only justifications that the last round's facts are premises of are looked at, and their
        # counts of premises met are kept, so a justification fires in the one round that completes it.
        counts = Growing(spark, "met")
        while pairs.head(1):
            hits = pairs.join(fresh.withColumnRenamed("id", "premise"), "premise", "left_semi").groupBy("justification").agg(F.count("*").alias("met"))
            hits = counts.append(hits)
            total = counts.read().join(hits.select("justification"), "justification", "left_semi").groupBy("justification").agg(F.sum("met").alias("met"))
            done = need.join(total, "justification").where("met = need").select("justification")
            facts = derives.join(done, "justification", "left_semi").select(F.col("fact").alias("id")).distinct()
            fresh = believed.append(facts.join(believed.read(), "id", "left_anti"))
            if not fresh.head(1):
                break
        supported = believed.read().distinct()
        if self.facts is not None:
            supported = supported.join(self.facts.where(F.coalesce("deleted", F.lit(False))), "id", "left_anti")
        return materialize(supported, "believed")

    def affected(self, ids: DataFrame) -> DataFrame:
        """Facts downstream of the ids."""
        seen = front = materialize(ids.select("id").distinct(), "front")
        start = seen
        while True:
            moved = materialize(self.premises.join(front.withColumnRenamed("id", "premise"), "premise", "left_semi").select("justification"), "moved")
            front = materialize(self.derives.join(moved, "justification", "left_semi").select(F.col("fact").alias("id")).distinct().join(seen, "id", "left_anti"), "front")
            forget(moved)
            if not front.head(1):
                return seen.join(start, "id", "left_anti")
            seen = seen.unionAll(front)

    def report(self, before: DataFrame, after: DataFrame, ids: DataFrame) -> DataFrame:
        """id, outcome of affected facts: died, revived, survived (another justification holds) or unaffected (wasn't held)."""
        rows = self.affected(ids).join(before.withColumn("was", F.lit(True)), "id", "left").join(after.withColumn("now", F.lit(True)), "id", "left")
        outcome = F.when(F.col("was") & F.col("now").isNull(), "died").when(F.col("was").isNull() & F.col("now"), "revived").when(F.col("was") & F.col("now"), "survived").otherwise("unaffected")
        return rows.select("id", outcome.alias("outcome"))

    def retract(self, ids: DataFrame) -> tuple[Provenance, DataFrame]:
        return self._changed(ids, True)

    def unretract(self, ids: DataFrame) -> tuple[Provenance, DataFrame]:
        return self._changed(ids, False)

    def _changed(self, ids: DataFrame, value: bool) -> tuple[Provenance, DataFrame]:
        before = self.holding()
        mark = ids.select("id").distinct().withColumn("__mark", F.lit(value))
        sources = self.sources.join(mark, "id", "left").withColumn("retracted", F.coalesce("__mark", "retracted")).drop("__mark")
        after = Provenance(sources, self.premises, self.derives, self.facts)
        return after, self.report(before, after.holding(), ids)

    def survived_via(self, held: DataFrame, ids: DataFrame, sources: DataFrame) -> DataFrame:
        """fact, justification: what still supports the given facts."""
        known = sources.where(~F.coalesce(F.col("retracted"), F.lit(False))).select("id").unionAll(held.select("id"))
        missing = self.premises.join(known.withColumnRenamed("id", "premise"), "premise", "left_anti").select("justification").distinct()
        return self.derives.join(missing, "justification", "left_anti").join(ids.withColumnRenamed("id", "fact"), "fact", "left_semi").select("fact", "justification")
