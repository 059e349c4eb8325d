"""Whole stages over the chunks of documents: discovery, schema generation, proposals, golden sets.

Model calls go through a provider behind the resumable cache of run_groups, so a stage that failed goes on where it ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import chunking as K
from ..operators import discovery as D
from ..operators import evaluation as E
from ..shared import checkpointed
from .providers import OPERATIONS, Provider, run_groups, with_fingerprints

#: Kinds of documents a schema can be asked for, and the length of the groups a stage works on.
DOCUMENT_TYPES = ("general", "legal")
GROUP_CHARS = 12_000


def group_replies(chunks: DataFrame, provider: Provider, operation: str, cache: str, limit: int = GROUP_CHARS, inputs: dict[str, str] | None = None, model: str = "replay", at_once: int = 5) -> DataFrame:
    """stem, group_index, reply: chunks (stem, chunk_id, path, text) packed into groups, each asked once."""
    texts = K.group_texts(chunks, K.packed_groups(chunks, "stem", "chunk_id", limit), "stem", "chunk_id")
    op = OPERATIONS[operation]
    marked = with_fingerprints(texts, op, operation, inputs or {}, model)
    return run_groups(marked, provider, op, cache, at_once).select("stem", "group_index", bare_json(F.col("reply")).alias("reply"))


def bare_json(reply):
    """A reply out of its code fence."""
    inside = F.regexp_extract(reply, r"(?s)^\s*```(?:[a-zA-Z]*)\s*(.*?)\s*```", 1)
    return F.when(inside != "", inside).otherwise(reply)


def consolidated(replies: DataFrame, payloads: DataFrame, provider: Provider, operation: str, cache: str, model: str = "replay", at_once: int = 5) -> DataFrame:
    """stem, reply: documents of one group keep their reply; of others the groups' candidates (stem, payload) are consolidated by one more call."""
    counts = replies.groupBy("stem").agg(F.count("*").alias("n"), F.max("reply").alias("reply"))
    several = payloads.join(counts.where("n > 1").select("stem"), "stem", "left_semi").select("stem", F.col("payload").alias("text"))
    op = OPERATIONS[operation]
    asked = run_groups(with_fingerprints(several, op, operation, {}, model), provider, op, cache, at_once)
    return counts.where("n = 1").select("stem", "reply").union(asked.select("stem", bare_json(F.col("reply"))))


def discover_documents(chunks: DataFrame, provider: Provider, cache: str) -> DataFrame:
    """stem, field, position, item of every document's discovery report; classes and relationships are consolidated by the model."""
    replies = checkpointed(group_replies(chunks, provider, "discover_ontology", f"{cache}/groups").withColumnRenamed("reply", "report"))
    payloads = D.consolidation_payloads(replies, ["stem"], "group_index")
    whole = consolidated(replies.withColumnRenamed("report", "reply"), payloads, provider, "consolidate_discovery", f"{cache}/documents")
    r = whole.select("stem", F.from_json("reply", "classes array<string>, relationships array<string>").alias("r"))
    listed = F.array(*(F.struct(F.lit(x).alias("field"), F.col(f"r.{x}").alias("items")) for x in ("classes", "relationships")))
    types = r.select("stem", F.explode(listed).alias("l")).select("stem", "l.field", F.posexplode("l.items").alias("position", "item"))
    return D.reduced_reports(replies, ["stem"], "group_index").union(types.select("stem", "field", F.col("position") + 1, "item"))


def schema_for_documents(chunks: DataFrame, provider: Provider, cache: str, document_type: str = "general") -> DataFrame:
    """stem, kind, pos, name, description, source, target of a schema for every document."""
    if document_type not in DOCUMENT_TYPES:
        raise ValueError(f"document type {document_type!r}; known: {', '.join(DOCUMENT_TYPES)}")
    replies = checkpointed(group_replies(chunks, provider, "generate_schema", f"{cache}/groups", inputs={"document_type": document_type}))
    part = F.struct(F.col("group_index").alias("group"), F.col("reply").alias("schema"))
    payloads = replies.groupBy("stem").agg(F.to_json(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["schema"])).alias("payload"))
    whole = consolidated(replies, payloads, provider, "consolidate_schema", f"{cache}/documents")
    kind = "array<struct<name:string, description:string, source:string, target:string>>"
    s = whole.select("stem", F.from_json("reply", f"node_types {kind}, edge_types {kind}").alias("s"))
    listed = F.array(F.struct(F.lit("node_type").alias("kind"), F.col("s.node_types").alias("items")), F.struct(F.lit("edge_type").alias("kind"), F.col("s.edge_types").alias("items")))
    return s.select("stem", F.explode(listed).alias("l")).select("stem", "l.kind", F.posexplode("l.items").alias("pos", "t")).select("stem", "kind", "pos", "t.*")


def proposed_changes(replies: DataFrame) -> DataFrame:
    """key, seq, decision, element_type, element (JSON) of evolution proposals (key, reply). A change that lacks one of the three raises."""
    changes = F.from_json(bare_json(F.col("reply")), "changes array<struct<decision:string, element_type:string, element:string>>")["changes"]
    rows = checkpointed(replies.select("key", F.posexplode(changes).alias("seq", "c")).select("key", "seq", "c.*"))
    bad = rows.where("decision is null or element_type is null or element is null").limit(1).collect()
    if bad:
        raise ValueError(f"change {bad[0].seq} of {bad[0].key} lacks decision, element_type or element")
    return rows


def golden_sets(questions: DataFrame, answers: DataFrame, documents: DataFrame, expected: DataFrame) -> DataFrame:
    """stem, new_id, question, question_type, answer, answerable, evidence: golden sets out of generated questions and answers.

    questions: stem, position, id, question, question_type; answers: stem, id, seq, answer, answerable, quote; documents:
    stem, text, or parts of it in the order of `part` with an empty line between them; expected: stem, n. Questions that are wrong in number, text or kind raise, as do answers for other
    questions. Quotes that are not in the document go; an answer without one left is not answerable. Questions equal up
    to case and spaces are one, and ids are given anew.
    """
    wrong = E.question_problems(questions, expected, ["stem"]).where("problem <> 'duplicate'").limit(1).collect()
    if wrong:
        raise ValueError(f"questions of {wrong[0].stem}: {wrong[0].problem}")
    told = E.matched_answers(questions, answers, ["stem", "id"], "seq")
    parts = documents if "part" in documents.columns else documents.withColumn("part", F.lit(0))
    held = E.held_quotes(answers, parts, "stem", "part").withColumn("held", F.lit(True))
    checked = told.join(held, ["stem", "quote"], "left").withColumn("evidence", F.when(F.col("held"), F.col("quote")))
    checked = checked.withColumn("answerable", F.coalesce(F.col("answerable"), F.lit(False)) & F.col("evidence").isNotNull())
    rows = checked.select("stem", "position", "question", "question_type", "answer", "answerable", "evidence")
    return E.renumbered(rows, ["stem"], "position").select("stem", "new_id", "question", "question_type", "answer", "answerable", "evidence")
