"""Problem 7: mixing sources to target weights.

Method: a document's size is its number of tokens. Every document gets a hash-random key; within its source the keys
are range-partitioned into buckets of about BUCKET_ROWS documents, buckets are summed and prefix-summed, and the
prefix sums are carried into the buckets, so that a source is cut at its budget without any task holding the source.
A source whose budget exceeds its size is used in whole epochs first, at most `max_repeats` times in all, and the cut
falls in the last epoch: a document is taken there while the running total stays within what is left.

Null and empty texts have size 0 and are used like any other. Documents without a source, or of a source that is not
listed, are not used. A listed source without documents has size 0. Null weights count as 0, null repeats as 1; a
source listed twice keeps the larger weight. Repeated documents count as they stand. A source falls short if the mix
holds every document of it max_repeats times and still less than its share.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pre-tokenizing pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 50_000_000
BUCKET_ROWS = 100_000
SEED = 20


def _counted(batches: Iterator[pa.RecordBatch], vocabulary: bytes, pattern: str) -> Iterator[pa.RecordBatch]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    encode = tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    for batch in batches:
        sizes = [len(encode(x)) if x else 0 for x in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])


def token_sizes(documents: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, tokens. The vocabulary file is read by the driver and sent to the tasks."""
    raw = Path(tokenizer).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{tokenizer} has {len(raw)} bytes; a vocabulary may have {MAX_VOCABULARY_BYTES}")
    sent = documents.sparkSession.sparkContext.broadcast(raw)
    return documents.select("doc_id", "source", "text").mapInArrow(lambda it: _counted(it, sent.value, pattern), "doc_id long, source string, tokens long")


class Mix:
    def __init__(self, documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER):
        plan = targets.where("source is not null").groupBy("source").agg(
            F.coalesce(F.max("target_weight"), F.lit(0.0)).alias("target_weight"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats")
        )
        listed = documents.join(plan.select("source"), "source", "left_semi")
        self.sizes = C.cut(token_sizes(listed, tokenizer))
        own = self.sizes.groupBy("source").agg(F.sum("tokens").alias("size"), F.count("*").alias("n_docs"))
        total = self.sizes.agg(F.sum("tokens")).first()[0] or 0
        budget = (
            plan.join(own, "source", "left")
            .fillna(0, ["size", "n_docs"])
            .withColumn("wanted", F.col("target_weight") * F.lit(float(total)))
            .withColumn("available", F.col("size") * F.col("max_repeats"))
            .withColumn("budget", F.least("wanted", F.col("available").cast("double")))
        )
        epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0)
        self.budgets = C.cut(
            budget.withColumn("epochs", F.least(epochs, F.col("max_repeats").cast("long")))
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))
            .withColumn("buckets", F.ceil(F.greatest(F.col("n_docs"), F.lit(1)) / BUCKET_ROWS))
        )

    def uses(self) -> DataFrame:
        """doc_id, source, tokens, n_uses of every document used at least once."""
        keyed = self.sizes.join(self.budgets.select("source", "epochs", "rest", "buckets"), "source")
        # 32 random bits, cut into equal ranges of keys.
        key = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(SEED)), 32)
        keyed = keyed.withColumn("key", key).withColumn("bucket", F.floor(F.col("key") * F.col("buckets") / F.lit(1 << 32)))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        starts = keyed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket")).withColumn("start", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)))
        upto = Window.partitionBy("source", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
        placed = keyed.join(starts.select("source", "bucket", "start"), ["source", "bucket"]).withColumn("upto", F.col("start") + F.sum("tokens").over(upto))
        last = F.when((F.col("rest") > 0) & (F.col("upto") <= F.col("rest")), 1).otherwise(0)
        return placed.select("doc_id", "source", "tokens", (F.col("epochs") + last).cast("long").alias("n_uses")).where("n_uses > 0")

    def shares(self) -> DataFrame:
        """One row a source: what was wanted, what could be had and what the mix reached."""
        used = C.cut(self.uses().groupBy("source").agg(F.sum(F.col("tokens") * F.col("n_uses")).alias("reached"), F.max("n_uses").alias("most_uses")))
        whole = used.agg(F.sum("reached")).first()[0] or 1
        return (
            self.budgets.join(used, "source", "left")
            .fillna(0, ["reached", "most_uses"])
            .withColumn("short", (F.col("reached") >= F.col("available")) & (F.col("reached") < F.col("wanted")))
            .withColumn("share", F.col("reached") / F.lit(whole))
            .select("source", "target_weight", "max_repeats", "n_docs", "size", "wanted", "available", "short", "reached", "most_uses", "share")
        )
