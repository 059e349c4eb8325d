"""Model and embedding calls as replayable functions, and the resumable map over groups.

Replies come from a table keyed by fingerprint or from a provider called once a group; what a provider returned is
kept by fingerprint, so retried tasks and later runs make no second call.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fingerprint
from ..shared import is_missing


@dataclass(frozen=True)
class Operation:
    """A kind of model call: the fields its reply must have (none for prose) and its ceiling of output tokens."""

    name: str
    required: tuple[str, ...] = ()
    max_tokens: int | None = None


# The operations and the fields of their replies.
OPERATIONS = {
    o.name: o
    for o in (
        Operation("discover_ontology", ("classes",)),
        Operation("consolidate_discovery", ("classes", "relationships")),
        Operation("generate_schema", ("node_types", "edge_types")),
        Operation("consolidate_schema", ("node_types", "edge_types")),
        Operation("extract_graph", ("nodes", "edges")),
        Operation("supplement_graph", ("nodes", "edges")),
        Operation("validate_ontology", ("validation_summary", "issues")),
        Operation("propose_evolution", ("changes",)),
        Operation("analyze_question", ("node_types", "edge_types")),
        Operation("judge_answerability", ("answerable",)),
        Operation("generate_goldenset_questions", ("questions",)),
        Operation("generate_goldenset_answers", ("answers",)),
        Operation("answer_chat"),
        Operation("summarize_document"),
    )
}


class Provider(Protocol):
    def __call__(self, operation: str, prompt: str) -> str: ...


class MalformedReply(ValueError):
    pass


def reply_text(content: str | list) -> str:
    """A reply that is a list of blocks counts as its text block."""
    return content if isinstance(content, str) else next((b["text"] for b in content if isinstance(b, dict) and b.get("type") == "text"), "")


def parse_reply(content: str | list, required: tuple[str, ...] = ()) -> dict:
    """The first complete JSON object of a reply, out of a code fence if there is one; text behind it is ignored."""
    text = reply_text(content).strip()
    fence = re.match(r"```[a-zA-Z]*\s*(.*?)\s*```", text, re.DOTALL)
    text = (fence.group(1) if fence else text).strip()
    try:
        value, _ = json.JSONDecoder().raw_decode(text)
    except ValueError as e:
        raise MalformedReply(f"no JSON: {text[:80]!r}") from e
    if not isinstance(value, dict) or any(k not in value for k in required):
        raise MalformedReply(f"fields missing of {required}")
    return value


def asked(provider: Provider, operation: Operation, prompt: str, asks: int = 2, retries: int = 2, pause: float = 1.0) -> str:
    """The reply, asked again once when malformed; connection errors are retried."""
    for k in range(asks):
        for r in range(retries + 1):
            try:
                reply = provider(operation.name, prompt)
                break
            except ConnectionError:
                if r == retries:
                    raise
                time.sleep(pause)
        if not operation.required:
            if reply_text(reply).strip():
                return reply_text(reply).strip()
        else:
            try:
                parse_reply(reply, operation.required)
                return reply_text(reply)
            except MalformedReply:
                pass
        if k == asks - 1:
            raise MalformedReply(f"{operation.name}: no usable reply")
    raise AssertionError


def _mapped(batches: Iterator[pa.RecordBatch], provider: Provider, operation: Operation, pause: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        replies, errors, seconds = [], [], []
        for prompt in batch.column("text").to_pylist():
            began = time.time()
            try:
                replies.append(asked(provider, operation, prompt, pause=pause))
                errors.append(None)
            except Exception as e:  # a failed group lets the others finish
                replies.append(None)
                errors.append(f"{type(e).__name__}: {e}"[:500])
            seconds.append(time.time() - began)
        yield pa.RecordBatch.from_arrays([batch.column("fingerprint"), pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(seconds)], names=["fingerprint", "reply", "error", "seconds"])


REPLIES = "fingerprint string, reply string, error string, seconds double"


def with_fingerprints(groups: DataFrame, operation: Operation, stage: str, inputs: dict[str, str], model: str) -> DataFrame:
    """groups with the digest of all that decides the reply: text, stage, inputs, model and ceiling."""
    parts = {
        "stage": F.lit(stage), "text": F.col("text"), "inputs": F.lit(json.dumps(inputs, sort_keys=True, ensure_ascii=False)),
        "operation": F.struct(F.lit(operation.name).alias("name"), F.lit(model).alias("model"), F.lit(operation.max_tokens).cast("int").alias("max_tokens")),
    }
    return groups.withColumn("fingerprint", fingerprint(parts))


def _parsed(batches: Iterator[pa.RecordBatch], required: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values, errors = [], []
        for reply in batch.column("reply").to_pylist():
            try:
                values.append(json.dumps(parse_reply(reply or "", required), ensure_ascii=False))
                errors.append(None)
            except MalformedReply as e:
                values.append(None)
                errors.append(str(e))
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(values, pa.string()), pa.array(errors, pa.string())], names=["key", "value", "error"])


def parsed_replies(replies: DataFrame, key: str, required: tuple[str, ...]) -> DataFrame:
    """key, value (JSON of the first complete object), error of replies (key LONG, reply): one of the two is null."""
    rows = replies.select(F.col(key).cast("long").alias("key"), "reply")
    return rows.mapInArrow(lambda it: _parsed(it, required), "key long, value string, error string").withColumnRenamed("key", key)


def map_concurrently(items: DataFrame, key: str, text: str, function: Callable[[str], str], at_once: int = 5) -> DataFrame:
    """key and `reply`, function of the text, of every item; `at_once` partitions bound the calls in flight, equal texts are asked once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            replies = [function(x) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(replies, pa.string())], names=["digest", "reply"])

    named = items.select(key, F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    replies = named.select("digest", "text").dropDuplicates(["digest"]).repartition(at_once).mapInArrow(run, "digest string, reply string")
    return named.select(key, "digest").join(replies, "digest").select(key, "reply")


def map_groups(groups: DataFrame, provider: Provider, operation: Operation, cache: DataFrame, at_once: int = 5, pause: float = 1.0) -> DataFrame:
    """fingerprint, reply, error, seconds of the groups not in the cache; `at_once` partitions bound the calls in flight.

    A cached row without a reply is a miss. Groups of equal fingerprint are asked once.
    """
    done = cache.where("reply is not null").select("fingerprint")
    todo = groups.select("fingerprint", "text").join(done, "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
    return todo.repartition(at_once).mapInArrow(lambda it: _mapped(it, provider, operation, pause), REPLIES)


def run_groups(groups: DataFrame, provider: Provider, operation: Operation, cache_path: str, at_once: int = 5, pause: float = 1.0) -> DataFrame:
    """groups with their replies. New replies are appended to the cache before a failure is raised, so the next run resumes."""
    spark = groups.sparkSession
    try:
        cache = spark.read.schema(REPLIES).parquet(cache_path)
    except AnalysisException as e:
        if not is_missing(e):
            raise
        cache = spark.createDataFrame([], REPLIES)
    map_groups(groups, provider, operation, cache, at_once, pause).write.mode("append").parquet(cache_path)
    cache = spark.read.schema(REPLIES).parquet(cache_path)
    replies = cache.where("reply is not null").groupBy("fingerprint").agg(F.max("reply").alias("reply"))
    failed = groups.join(replies, "fingerprint", "left_anti").join(cache.where("error is not null"), "fingerprint").limit(1).collect()
    if failed:
        raise RuntimeError(f"a group failed: {failed[0].error}")
    return groups.join(replies, "fingerprint")


def replayed(groups: DataFrame, replies: DataFrame) -> DataFrame:
    """groups with the replies of a table (fingerprint, reply)."""
    return groups.join(replies.select("fingerprint", "reply"), "fingerprint")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 256) -> DataFrame:
    """id, vector of texts (id, text); the provider gets up to `batch` texts a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, own = b.column("id"), b.column("text").to_pylist()
            vectors = [v for k in range(0, len(own), batch) for v in embed(own[k : k + batch])]
            yield pa.RecordBatch.from_arrays([ids, pa.array(vectors, pa.list_(pa.float32()))], names=["id", "vector"])

    return texts.select(F.col("id").cast("string").alias("id"), "text").mapInArrow(run, "id string, vector array<float>")


def unbundled(replies: DataFrame, kind: str) -> DataFrame:
    """Nodes or edges of extraction replies, with the position in their list; incomplete items are kept for later checks."""
    node = "id string, label string, type string, detail string, properties map<string,string>, evidence string, source_section string, confidence string"
    edge = "source string, target string, type string, detail string, evidence string, confidence string"
    items = F.from_json("reply", f"nodes array<struct<{_typed(node)}>>, edges array<struct<{_typed(edge)}>>")[kind]
    return replies.select("*", F.posexplode(items).alias("position", "item")).select(*[c for c in replies.columns if c != "reply"], "position", "item.*")


def _typed(fields: str) -> str:
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", fields)
