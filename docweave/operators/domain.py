"""Domain convergence metrics over documents and their graphs."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import checkpointed, is_missing
from .schema import apply_changes


def utilization(types: DataFrame, instances: DataFrame, documents: DataFrame) -> DataFrame:
    """Share of documents with at least one instance, for every declared type. types: type; instances: stem, type; documents: stem."""
    total = documents.select("stem").distinct().agg(F.count("*").alias("total"))
    having = instances.groupBy("type").agg(F.countDistinct("stem").alias("n"))
    share = F.when(F.col("total") > 0, F.coalesce("n", F.lit(0)) / F.col("total")).otherwise(0.0)
    return types.select("type").distinct().join(having, "type", "left").crossJoin(F.broadcast(total)).select("type", F.round(share, 6).alias("utilization"))


def consistency(types: DataFrame, counts: DataFrame, documents: DataFrame) -> DataFrame:
    """Population deviation over documents of a type's instances per 1,000 characters; documents without any count as 0.

    counts: stem, type, n; documents: stem, chars. From sums over the documents that have the type, so the grid of
    types and documents is never laid out.
    """
    total = documents.agg(F.count("*").alias("docs"))
    density = F.when(F.col("chars") > 0, F.col("n") * 1000.0 / F.col("chars")).otherwise(0.0)
    sums = counts.join(documents, "stem").groupBy("type").agg(F.sum(density).alias("s"), F.sum(density * density).alias("q"))
    joined = types.select("type").distinct().join(sums, "type", "left").fillna(0.0, ["s", "q"]).crossJoin(F.broadcast(total))
    variance = F.col("q") / F.col("docs") - (F.col("s") / F.col("docs")) ** 2
    return joined.select("type", F.round(F.sqrt(F.greatest(variance, F.lit(0.0))), 4).alias("deviation"))


def coverage(iterations: DataFrame) -> DataFrame:
    """Mean issue and missing-element counts; zeros without iterations. iterations: issue_count, missing_count."""
    return iterations.agg(*(F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(f"mean_{c}") for c in ("issue_count", "missing_count")))


#: Decisions that may be applied without review.
APPLICABLE = ("ADD", "MODIFY", "MERGE", "DEPRECATE")


def converge(seed: DataFrame, proposals: DataFrame, scope: list[str], documents: list[str]) -> tuple[DataFrame, DataFrame]:
    """(types, pending) after all proposals of the documents, folded in document order.

    seed: scope, name, pos, description. proposals: scope, name, decision, element_type, description, position and the
    `documents` columns that order documents. With the replies at hand the fold over documents is one ordered change
    list per type, so it needs no loop; pending keeps what a person must review, with its document.
    """
    types = proposals.where(F.col("element_type").isin("node_type", "edge_type"))
    order = F.struct(*documents, "position")
    changes = types.where(F.col("decision").isin(*APPLICABLE)).select(*scope, "name", order.alias("seq"), "decision", "description")
    merged = apply_changes(seed.withColumn("pos", F.struct(*(F.lit(None).cast(proposals.schema[c].dataType).alias(c) for c in documents), F.col("pos").cast(proposals.schema["position"].dataType).alias("position"))), changes, scope)
    return merged, types.where(F.col("decision") == "NEEDS_HUMAN_REVIEW").select(*scope, *documents, "name", "position")


class DomainStore:
    """What convergence runs leave behind per domain: the stems it was calibrated on, the history of documents, the queue for review.

    All are appended; a resolution is a row of its own and takes what was queued for its change before it.
    """

    TABLES = {"stems": "domain string, stem string", "history": "domain string, stem string, at long", "pending": "domain string, change_id string, at long", "resolved": "domain string, change_id string, at long"}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.TABLES[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], self.TABLES[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def append_run(self, stems: DataFrame, documents: DataFrame, pending: DataFrame) -> None:
        """stems and documents: domain, stem; pending: domain, change_id, one row a queued change."""
        at = F.lit(time.time_ns()).alias("at")
        self._append("stems", checkpointed(stems.select("domain", "stem").distinct().join(self._read("stems"), ["domain", "stem"], "left_anti")))
        self._append("history", documents.select("domain", "stem", at))
        self._append("pending", pending.select("domain", "change_id", at))

    def resolve(self, changes: DataFrame) -> None:
        self._append("resolved", changes.select("domain", "change_id", F.lit(time.time_ns()).alias("at")))

    def stems(self) -> DataFrame:
        return self._read("stems").distinct()

    def history(self) -> DataFrame:
        return self._read("history")

    def pending(self) -> DataFrame:
        """Queued changes not resolved since; a null id only matches a null id."""
        done = self._read("resolved").groupBy("domain", "change_id").agg(F.max("at").alias("done_at")).alias("r")
        queue = self._read("pending").alias("q")
        same = (F.col("q.domain") == F.col("r.domain")) & F.col("q.change_id").eqNullSafe(F.col("r.change_id")) & (F.col("q.at") < F.col("r.done_at"))
        return queue.join(done, same, "left_anti")
