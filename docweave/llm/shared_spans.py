"""Problem 1: long exact spans shared between records.

Method: every run of `gram` characters is a token with a 64-bit min-hash. The Cartesian tree over a text's token
hashes yields *compact windows* (left, centre, right): all token subsequences within [left, right] that hold the
centre have the centre's hash as their minimum. Windows narrower than the span sought are cut off, so a text of n
tokens leaves about 2n/t of them. Two texts that share a span of t tokens have windows with the same min-hash around
it, under any hash function, so one function already finds every exact span; windows of equal hash are joined with
the condition that their intervals leave room for t tokens, and the texts around the centres are then compared.

The interval join of a hash that very many windows share (a clause standing in many records) would form all their
pairs, most of which leave room and yet do not share. Its intervals are therefore cut further, into all their runs of the
full span length, which are joined by their own hashes: equal runs are exactly the spans sought, so no pair is formed
that does not share, and joins of large groups are salted. Both ways are exact; HOT only chooses the cheaper one.

Null and empty texts and texts shorter than the span form no pair. In the coverage every record has a row; a text shorter
than the span stands in others only where another record has the same text. Records with the same text are one class until the
end; each table (kind) is compared only with itself. Repeated rows of one id count once. Columns other than id and
text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

SPAN = 240
GRAM = 128
HOT = 64


def compact_windows(hashes: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Nodes (left, centre, right inclusive) of the Cartesian tree that are at least `least` tokens wide.

    Equal minima split from the left, all at once, so periodic text costs no more than other text.
    """
    out: list[tuple[int, int, int]] = []
    stack = [(0, len(hashes))]
    while stack:
        lo, hi = stack.pop()
        if hi - lo < least:
            continue
        part = hashes[lo:hi]
        at = int(part.argmin())
        ties = [at] if part[at + 1 :].size == 0 or part[at + 1 :].min() != part[at] else np.flatnonzero(part == part[at]).tolist()
        left = lo
        for k in ties:
            if hi - left < least:
                break
            out.append((left, lo + k, hi - 1))
            stack.append((left, lo + k))
            left = lo + k + 1
        else:
            stack.append((left, hi))
    return out


def kind_salt(kind: str) -> np.uint64:
    """Keeps the hashes of one kind of record apart from those of another."""
    return np.uint64(xxhash.xxh64_intdigest(kind))


def _windows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    least = span - gram + 1
    for batch in batches:
        classes, texts = batch.column("cls").to_pylist(), batch.column("text").to_pylist()
        kinds = batch.column("rec_kind").to_pylist()
        fresh = list({c: k for k, c in enumerate(classes) if len(texts[k]) >= span}.values())  # copies within a batch give their windows once
        for first, held in C.blocks(texts[k] for k in fresh):
            points, offsets = C.joined(held)
            hashes = C.gram_hashes(C.prefix_sums(points), gram)
            keys, cls, centre, left, right = [], [], [], [], []
            for j in range(len(held)):
                own = hashes[offsets[j] : offsets[j + 1] - gram + 1]
                found = compact_windows(own, least)
                w = np.array(found, dtype=np.int64)
                keys.append(own[w[:, 1]] ^ kind_salt(kinds[fresh[first + j]]))
                cls += [classes[fresh[first + j]]] * len(w)
                centre.append(w[:, 1])
                left.append(np.minimum(w[:, 1] - w[:, 0], least - 1))
                right.append(np.minimum(w[:, 2] - w[:, 1], least - 1))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(cls, pa.binary()),
                        pa.array(np.concatenate(centre).astype(np.int32)),
                        pa.array(np.concatenate(left).astype(np.int16)),
                        pa.array(np.concatenate(right).astype(np.int16)),
                    ],
                    names=["key", "cls", "centre", "room_left", "room_right"],
                )


def _runs(a: str, b: str, anchors: list[dict], gram: int, span: int) -> list[tuple[int, int, int]]:
    """Maximal common runs through the anchors, of at least `span` characters."""
    out: list[tuple[int, int, int]] = []
    done: dict[int, int] = {}
    for x in sorted(anchors, key=lambda x: x["a"]):
        i, j = x["a"], x["b"]
        if i < done.get(i - j, -1) or a[i : i + gram] != b[j : j + gram]:
            continue
        pa_, pb_ = a[:i][::-1], b[:j][::-1]
        left, right = _common(pa_, pb_), gram + _common(a[i + gram :], b[j + gram :])
        done[i - j] = i + right
        if left + right >= span:
            out.append((i - left, j - left, left + right))
    return out


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by doubling steps and then halving."""
    most, k, step = min(len(a), len(b)), 0, 64
    while k < most and a[k : k + step] == b[k : k + step]:
        k, step = min(k + step, most), step * 2
    lo, hi = k, min(k + step, most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[k:mid] == b[k:mid] else (lo, mid - 1)
    return lo


def _verified(batches: Iterator[pa.RecordBatch], gram: int, span: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [
            (r["cls_a"], r["cls_b"], i, j, n)
            for r in batch.to_pylist()
            for i, j, n in _runs(r["text_a"], r["text_b"], r["anchors"], gram, span)
        ]
        if out:
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), kinds)], names=["cls_a", "cls_b", "start_a", "start_b", "length"])


def _full_grams(batches: Iterator[pa.RecordBatch], gram: int, span: int) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all runs of span characters that hold the gram at one of the centres."""
    for batch in batches:
        for r in batch.to_pylist():
            points = C.code_points(r["text"])
            sums = [C.prefix_sums(points), C.prefix_sums(points ^ np.uint32(0x5BD1E995))]
            starts = sorted({s for c in r["centres"] for s in range(max(0, c - span + gram), min(c, len(points) - span) + 1)})
            if starts:
                one, two = ((C.gram_hashes(s, span)[starts] ^ kind_salt(r["rec_kind"])).view(np.int64) for s in sums)
                yield pa.RecordBatch.from_arrays([pa.array([r["cls"]] * len(starts), pa.binary()), pa.array(one), pa.array(two), pa.array(starts, pa.int32())], names=["cls", "g1", "g2", "start"])


def text_class(kind: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(kind, F.lit("|"), text)))


class SharedSpans:
    """Spans of at least `span` characters that records of one kind share word for word.

    records: DataFrame with rec_kind STRING, rec_id LONG, text STRING.
    """

    def __init__(self, records: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT):
        least = span - gram + 1
        self.span = span
        records = records.select("rec_kind", "rec_id", "text")
        full = records.where(F.length("text") >= span)
        classed = lambda x: x.select("rec_kind", "rec_id", text_class(F.col("rec_kind"), F.col("text")).alias("cls"), F.length("text").alias("n_chars")).distinct()
        self.members = classed(full)
        self.written = classed(records.where(F.length("text") > 0))
        self.blank = records.where(F.coalesce(F.length("text"), F.lit(0)) == 0).select("rec_kind", "rec_id").distinct()
        texts = full.select(text_class(F.col("rec_kind"), F.col("text")).alias("cls"), "rec_kind", "text")
        windows = C.cut(texts.select("cls", "text", "rec_kind").mapInArrow(lambda it: _windows(it, span, gram), "key long, cls binary, centre int, room_left short, room_right short"))
        mark = F.xxhash64("cls")
        shared = windows.groupBy("key").agg(F.min(mark).alias("low"), F.max(mark).alias("high"), F.count("*").alias("n")).where("low <> high").select("key", "n")
        # Spread by more than the key, so that the join before may split a hot key.
        held = C.cut(windows.join(shared, "key").repartition("key", "cls", "centre").dropDuplicates(["key", "cls", "centre"]))
        usual, hot_windows = held.where(F.col("n") <= hot), held.where(F.col("n") > hot)
        a, b = (usual.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("cls", "centre", "room_left", "room_right"))) for x in "ab")
        room = F.least("room_left_a", "room_left_b") + F.least("room_right_a", "room_right_b") + 1
        candidates = (
            a.join(b, "key")
            .where((F.col("cls_a") < F.col("cls_b")) & (room >= least))
            .groupBy("cls_a", "cls_b")
            .agg(F.collect_set(F.struct(F.col("centre_a").alias("a"), F.col("centre_b").alias("b"))).alias("anchors"))
        )
        candidates = C.cut(candidates)
        needed = candidates.select(F.col("cls_a").alias("cls")).union(candidates.select(F.col("cls_b").alias("cls"))).distinct()
        some = C.cut(texts.select("cls", "text").join(needed, "cls", "left_semi").dropDuplicates(["cls"]))
        self.runs = C.cut(
            candidates.join(some.select(F.col("cls").alias("cls_a"), F.col("text").alias("text_a")), "cls_a")
            .join(some.select(F.col("cls").alias("cls_b"), F.col("text").alias("text_b")), "cls_b")
            .mapInArrow(lambda it: _verified(it, gram, span), "cls_a binary, cls_b binary, start_a int, start_b int, length int")
        )
        centres = hot_windows.groupBy("cls").agg(F.collect_set("centre").alias("centres"))
        grams = texts.join(centres, "cls").dropDuplicates(["cls"]).mapInArrow(lambda it: _full_grams(it, gram, span), "cls binary, g1 long, g2 long, start int")
        groups = grams.groupBy("g1", "g2").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("g1", "g2")
        self.hot_grams = C.cut(grams.join(groups, ["g1", "g2"])) if not hot_windows.isEmpty() else None

    def class_pairs(self) -> DataFrame:
        pairs = self.runs.select("cls_a", "cls_b")
        if self.hot_grams is not None:
            once = self.hot_grams.select("g1", "g2", "cls").distinct()
            # Runs of one length with the same members differ by position only: one of them gives the pairs.
            same = once.groupBy("g1", "g2").agg(F.count("*").alias("n"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("sig"))
            keep = same.groupBy("n", "sig").agg(F.min(F.struct("g1", "g2")).alias("g")).select("g.*")
            same_run = C.pairs_within(once.join(keep, ["g1", "g2"]), ["g1", "g2"], "cls")
            pairs = pairs.union(same_run.select("a", "b"))
        return pairs.distinct()

    def record_pairs(self) -> DataFrame:
        """rec_kind, id_a < id_b: every pair of records that share a span; records of equal text included."""
        pairs = self.class_pairs()
        ids = pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct()
        m = self.members.join(ids, "cls").select("cls", "rec_kind", "rec_id")
        one = m.select(F.col("cls").alias("cls_a"), "rec_kind", F.col("rec_id").alias("x"))
        two = m.select(F.col("cls").alias("cls_b"), F.col("rec_id").alias("y"))
        across = pairs.join(one, "cls_a").join(two, "cls_b").select("rec_kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        within = C.pairs_within(self.members, ["cls", "rec_kind"], "rec_id").select("rec_kind", F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        return across.where("id_a < id_b").union(within)

    def coverage(self) -> DataFrame:
        """rec_kind, rec_id, n_chars, shared_chars, shared_share: how much of each record stands in others, in runs of `span` or as a copy.

        Null and empty texts have 0 in all three.
        """
        pieces = self.runs.select(F.col("cls_a").alias("cls"), F.col("start_a").alias("s"), (F.col("start_a") + F.col("length")).alias("e")).union(
            self.runs.select("cls_b", "start_b", F.col("start_b") + F.col("length"))
        )
        if self.hot_grams is not None:
            pieces = pieces.union(self.hot_grams.select("cls", "start", F.col("start") + self.span))
        pieces = pieces.distinct()
        merged = pieces.groupBy("cls").agg(
            F.aggregate(
                F.array_sort(F.collect_list(F.struct("s", "e"))),
                F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto")),
                lambda acc, x: F.struct(
                    (acc["total"] + F.greatest(x["e"] - F.greatest(x["s"], acc["upto"]), F.lit(0))).alias("total"),
                    F.greatest(acc["upto"], x["e"]).alias("upto"),
                ),
                lambda acc: acc["total"],
            ).alias("covered")
        )
        copies = self.written.groupBy("cls").agg(F.count("*").alias("n_copies"))
        shared = F.when(F.col("n_copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
        written = (
            self.written.join(copies, "cls")
            .join(merged, "cls", "left")
            .select("rec_kind", "rec_id", F.col("n_chars").cast("long").alias("n_chars"), shared.cast("long").alias("shared_chars"), F.round(shared / F.col("n_chars"), 6).alias("shared_share"))
        )
        nothing = self.blank.select("rec_kind", "rec_id", F.lit(0).cast("long").alias("n_chars"), F.lit(0).cast("long").alias("shared_chars"), F.lit(0.0).alias("shared_share"))
        return written.union(nothing)



def records_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.select(F.lit("doc").alias("rec_kind"), F.col("doc_id").alias("rec_id"), "text").union(
        chunks.select(F.lit("chunk"), F.col("chunk_id"), "text")
    )
