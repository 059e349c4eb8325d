"""Discovery reports of the groups of a document reduced to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lists of a report and the fields that make two of their items the same; none means the whole item.
LISTS = {"attributes": ("name", "defined_on"), "events": ("name",), "rules": ("name",), "terminology": ("canonical_term",), "competency_questions": (), "warnings": ()}
DOMAIN_LISTS = ("subdomains", "document_types", "business_processes", "major_actors")
#: What of the candidates of a group is sent to be consolidated.
CLASS_FIELDS, RELATIONSHIP_FIELDS = ("name", "definition", "category"), ("name", "definition", "source", "target", "category")


def _parsed(report: Column) -> Column:
    domain = ", ".join(f"{x}:array<string>" for x in DOMAIN_LISTS)
    return F.from_json(report, f"domain_model struct<domain:string, {domain}>, " + ", ".join(f"{x} array<string>" for x in LISTS))


def reduced_reports(reports: DataFrame, scope: list[str], order: str) -> DataFrame:
    """scope, field, position (from 1), item: the first of equal items in the order of the groups; `domain` is the first that is not empty.

    reports: scope, order, report (JSON). Items that are objects stay JSON text.
    """
    r = reports.select(*scope, F.col(order).alias("group_"), _parsed(F.col("report")).alias("r"))
    domain = r.where(F.col("r.domain_model.domain") != "").groupBy(*scope).agg(F.min_by("r.domain_model.domain", "group_").alias("item"))
    out = domain.select(*scope, F.lit("domain").alias("field"), F.lit(1).alias("position"), "item")
    fields = {x: (F.col(f"r.domain_model.{x}"), ()) for x in DOMAIN_LISTS} | {x: (F.col(f"r.{x}"), key) for x, key in LISTS.items()}
    listed = F.array(*(F.struct(F.lit(name).alias("field"), items.alias("items"), F.lit(len(key) > 0).alias("keyed")) for name, (items, key) in fields.items()))
    each = r.select(*scope, "group_", F.explode(listed).alias("l")).select(*scope, "group_", "l.field", F.posexplode("l.items").alias("place", "item"))
    keys = {n: F.to_json(F.array(*(F.get_json_object("item", f"$.{k}") for k in key))) for n, key in LISTS.items() if key}
    same = F.col("item")
    for name, key in keys.items():
        same = F.when(F.col("field") == name, key).otherwise(same)
    first = each.withColumn("key_", same).groupBy(*scope, "field", "key_").agg(F.min_by(F.struct("item", "group_", "place"), F.struct("group_", "place")).alias("x"))
    turn = F.row_number().over(Window.partitionBy(*scope, "field").orderBy("x.group_", "x.place"))
    return out.union(first.select(*scope, "field", turn.alias("position"), "x.item"))


def consolidation_payloads(reports: DataFrame, scope: list[str], order: str) -> DataFrame:
    """scope, payload: the candidate classes and relationships of all groups of a document, in order, with the fields a consolidation needs."""
    told = lambda fields: "array<struct<" + ", ".join(f"{f}:string" for f in fields) + ">>"
    r = reports.select(*scope, F.col(order).alias("group"), F.from_json("report", f"classes {told(CLASS_FIELDS)}, relationships {told(RELATIONSHIP_FIELDS)}").alias("r"))
    part = F.struct("group", F.coalesce("r.classes", F.array()).alias("classes"), F.coalesce("r.relationships", F.array()).alias("relationships"))
    return r.groupBy(*scope).agg(F.to_json(F.array_sort(F.collect_list(part))).alias("payload"))
