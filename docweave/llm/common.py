"""Shared pieces of the training-data operators: tables, checkpoints, text arrays and gram hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import checkpointed

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BLOCK_CHARS = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read from there, so that lost executors cost no recomputation."""
    return checkpointed(df)


def pairs_within(rows: DataFrame, keys: list[str], value: str, block: int = 1000) -> DataFrame:
    """keys, a < b for every two rows of equal keys and different `value`.

    A key with n rows is salted over n / block tasks: each row goes to one of them and meets a copy of all in each.
    """
    blocks = rows.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks_"), F.count("*").alias("n_")).where("n_ > 1").drop("n_")
    held = rows.select(*keys, value).join(blocks, keys)
    one = held.select(*keys, F.col(value).alias("a"), F.pmod(F.xxhash64(value), F.col("blocks_")).cast("int").alias("salt_"))
    two = held.select(*keys, F.col(value).alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)).alias("salt_"))
    return one.join(two, [*keys, "salt_"]).where("a < b").select(*keys, "a", "b")


SKETCH_BITS = 24


def likely_in(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """rows whose `column` is among ids (one column of that name), and few others: for use before an exact join.

    The ids are hashed into a bitmap of 2 ** SKETCH_BITS bits, at most 2 ** (SKETCH_BITS - 6) words of 64, which is
    broadcast whatever the number of ids. With many more ids than bits it leaves out nothing and costs little.
    """
    place = F.pmod(F.xxhash64(column), F.lit(1 << SKETCH_BITS))
    word, bit = F.shiftright(place, 6), place.bitwiseAND(F.lit(63)).cast("int")
    words = ids.select(word.alias("word_"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("bit_")).groupBy("word_").agg(F.bit_or("bit_").alias("bits_"))
    marked = rows.withColumn("word_", word).join(F.broadcast(words), "word_")
    return marked.where(F.getbit("bits_", bit) == 1).select(rows.columns)


def compact(text: str) -> str:
    """Compatibility form without white space."""
    return "".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


def letters_only(text: str) -> str:
    """Compatibility form, case-folded, letters and digits only."""
    x = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", text).casefold()
    return "".join(filter(str.isalnum, x))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK_CHARS + (BLOCK_CHARS >> 2))
        _powers["up"] = np.cumprod(np.full(size, BASE, dtype=np.uint64))
        _powers["down"] = np.cumprod(np.full(size, INVERSE, dtype=np.uint64))
    return _powers["up"], _powers["down"]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_sums(points: np.ndarray) -> np.ndarray:
    """Sums S with S[j] the polynomial hash of the first j code points; see span_hashes."""
    a = mix(points.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    out = np.empty(len(a) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(a * powers(len(a))[0][: len(a)], out=out[1:])
    return out


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """64-bit hash of each run of `width` code points; equal runs have equal hashes wherever they stand."""
    n = len(sums) - width
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    return mix((sums[width:] - sums[:n]) * powers(n)[1][:n])


def blocks(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) in runs of about `limit` characters; a longer text is a block of its own."""
    start, held, chars, k = 0, [], 0, -1
    for k, text in enumerate(texts):
        if held and chars + len(text) > limit:
            yield start, held
            start, held, chars = k, [], 0
        held.append(text)
        chars += len(text)
    if held:
        yield start, held


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in a row and the offsets where each begins, one more than texts."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    return code_points("".join(texts)), offsets


def grams_within(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the joined code points at which a run of `width` stays within one text, and that text's index."""
    count = np.maximum(offsets[1:] - offsets[:-1] - width + 1, 0)
    owner = np.repeat(np.arange(len(count)), count)
    begin = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return np.arange(len(owner)) + begin, owner
