"""Problem 6: evaluation texts leaking into training text.

Method: the test items form a BM25 inverted index over character grams of their folded text, ordered in blocks of
items with the largest weight of every gram in every block. Each document is a row of overlapping passages, and every
passage is a query: as in block-max WAND, a block is opened only if the block maxima of the passage's grams reach the
least threshold in it, and an item is retrieved only if its own weights reach its threshold. An item's threshold is
the least total weight of the grams in any run of `share` of it, so no passage that holds such a run is missed. For
what is retrieved the longest common run of the passage and of the whole document is measured exactly; of the item's
question the share found in the document is reported too.

Folding keeps letters and digits, in lower case and normal width. Items of which the needed run is shorter than a
gram are indexed by grams of that length, one of which alone makes a candidate; empty ones are no items. Items of more
than PART_CHARS characters together are indexed and searched in parts, each by a hash of the item's id: an index of any
one part fits a task, and the parts together answer for all items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SHARE = 0.55
GRAM = 8
PASSAGE = 1024
BLOCK_ITEMS = 8
PART_CHARS = 4_000_000
K1, B = 1.2, 0.75
FILTER_BITS = 22


class ItemIndex:
    """Inverted index of folded passages; grams are numbered, postings are kept by gram for blocks and for items."""

    def __init__(self, ids: list[int], passages: list[str], questions: list[str], share: float = SHARE, gram: int = GRAM):
        kept = [(i, C.letters_only(p or ""), C.letters_only(q or "")) for i, p, q in zip(ids, passages, questions)]
        kept = sorted({k for k in kept if k[1]}, key=lambda k: (k[1], k[0]))  # items with common openings share blocks
        self.ids, self.texts, self.questions = [k[0] for k in kept], [k[1] for k in kept], [k[2] for k in kept]
        self.share, self.gram, n = share, gram, len(kept)
        self.need = [max(1, int(np.ceil(round(share * len(x), 6)))) for x in self.texts]
        self.overlap = max([gram, *(len(x) for x in self.texts)])
        hashes = [C.gram_hashes(C.prefix_sums(C.code_points(x)), gram) for x in self.texts]
        every = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint64)
        self.grams, number = np.unique(every, return_inverse=True)
        item = np.repeat(np.arange(n), [len(h) for h in hashes])
        pair, tf = np.unique(np.stack([number, item], axis=1) if len(number) else np.empty((0, 2), dtype=np.int64), axis=0, return_counts=True)
        df = np.bincount(pair[:, 0], minlength=len(self.grams))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        size = np.array([len(h) for h in hashes] or [1], dtype=float)
        weight = idf[pair[:, 0]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[pair[:, 1]] / max(1.0, size.mean())))
        self.by_item = (np.searchsorted(pair[:, 0], np.arange(len(self.grams) + 1)), pair[:, 1], weight)
        own_weight = weight[np.searchsorted(pair[:, 0] * n + pair[:, 1], number * n + item)] if len(number) else np.empty(0)
        self.threshold = self._thresholds(number, item, own_weight, np.array([len(h) for h in hashes], dtype=np.int64))
        #: By length, the hashes of all grams of the items whose needed run is that short, and the item of each.
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for width in sorted({x for x in self.need if x < gram}):
            few = [k for k in range(n) if self.need[k] == width]
            grams = [np.unique(C.gram_hashes(C.prefix_sums(C.code_points(self.texts[k])), width)) for k in few]
            every, of = np.concatenate(grams), np.repeat(few, [len(x) for x in grams])
            order = np.argsort(every, kind="stable")
            self.short[width] = every[order], of[order]
        block = pair[:, 1] // BLOCK_ITEMS
        at = pair[:, 0] * (n // BLOCK_ITEMS + 1) + block
        order = np.lexsort((-weight, at))
        first = np.concatenate([[True], at[order][1:] != at[order][:-1]]) if len(at) else np.empty(0, dtype=bool)
        top = order[first]
        self.by_block = (np.searchsorted(pair[top, 0], np.arange(len(self.grams) + 1)), block[top], weight[top])
        self.n_blocks = n // BLOCK_ITEMS + 1
        self.block_need = np.array([np.min(self.threshold[k * BLOCK_ITEMS : (k + 1) * BLOCK_ITEMS], initial=np.inf) for k in range(self.n_blocks)])
        self.most = np.zeros(len(self.grams))
        np.maximum.at(self.most, pair[:, 0], weight)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[self.grams >> np.uint64(64 - FILTER_BITS)] = True

    def _thresholds(self, number: np.ndarray, item: np.ndarray, weight: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each item the least total weight of the distinct grams in any run of the needed length; infinite for shorter runs.

        A gram at place j counts in a window that begins at s if s <= j < s + width and it did not stand between s and j
        before, so it adds its weight to one interval of s, and all windows are summed in one pass.
        """
        out = np.full(len(size), np.inf)
        if not len(number):
            return out
        place, begin = np.arange(len(number)), np.concatenate([[0], np.cumsum(size)])
        width = (np.array(self.need) - self.gram + 1)[item]
        order = np.lexsort((place, number, item))
        same = (number[order][1:] == number[order][:-1]) & (item[order][1:] == item[order][:-1])
        before = np.full(len(number), -1)
        before[order[1:][same]] = order[:-1][same]
        low = np.maximum(np.maximum(before + 1, place - width + 1), begin[item])
        weight = np.where(width >= 1, weight, 0.0)
        low = np.minimum(low, len(number))
        edge = np.bincount(low, weight, minlength=len(number) + 1) - np.bincount(place + 1, weight, minlength=len(number) + 1)
        sums = np.cumsum(edge[:-1])
        whole = (width >= 1) & (place + width <= begin[item + 1])
        np.minimum.at(out, item[whole], sums[whole])
        return out - 1e-6

    def short_items(self, sums: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of texts that hold a gram of an item's needed length, for items whose needed run is less than a gram."""
        out: set[tuple[int, int]] = set()
        for width, (grams, items) in self.short.items():
            hashes = C.gram_hashes(sums, width)
            at = np.flatnonzero(np.isin(hashes, grams))
            text = np.searchsorted(offsets, at, side="right") - 1
            inside = at + width <= offsets[text + 1]
            at, text = at[inside], text[inside]
            low, high = np.searchsorted(grams, hashes[at], side="left"), np.searchsorted(grams, hashes[at], side="right")
            for k, i, j in zip(text.tolist(), low.tolist(), high.tolist()):
                out.update((k, int(x)) for x in items[i:j])
        return out

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram occurs in the index, and the grams' numbers."""
        at = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        if not len(self.grams) or not len(at):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        number = np.minimum(np.searchsorted(self.grams, hashes[at]), len(self.grams) - 1)
        right = self.grams[number] == hashes[at]
        return at[right], number[right]

    @staticmethod
    def _spread(postings: tuple, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each gram its postings: index into grams, target, weight."""
        begin, target, weight = postings
        count = begin[grams + 1] - begin[grams]
        source = np.repeat(np.arange(len(grams)), count)
        at = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[grams], count)
        return source, target[at], weight[at]

    def retrieve(self, passage: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all items that reach their thresholds, for queries given as (passage, gram) hits."""
        nothing = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if not len(passage) or not np.isfinite(self.threshold).any():
            return nothing
        span = len(self.grams)
        hits = np.unique(passage * span + gram)
        passage, gram = hits // span, hits % span
        # Most passages cannot reach any threshold even with the largest weight of each of their grams.
        names, own = np.unique(passage, return_inverse=True)
        hopeful = (np.bincount(own, self.most[gram]) >= self.threshold.min())[own]
        passage, gram = passage[hopeful], gram[hopeful]
        if not len(passage):
            return nothing
        names, own = np.unique(passage, return_inverse=True)
        source, block, weight = self._spread(self.by_block, gram)
        bound = np.bincount(own[source] * self.n_blocks + block, weight, minlength=len(names) * self.n_blocks).reshape(len(names), self.n_blocks)
        opened = bound >= self.block_need
        keep = opened.any(axis=1)[own]
        passage, gram, own = passage[keep], gram[keep], own[keep]
        source, item, weight = self._spread(self.by_item, gram)
        inside = opened[own[source], item // BLOCK_ITEMS]
        source, item, weight = source[inside], item[inside], weight[inside]
        pair, at = np.unique(passage[source] * len(self.ids) + item, return_inverse=True)
        score = np.bincount(at, weight, minlength=len(pair))
        good = score >= self.threshold[pair % len(self.ids)]
        return pair[good] // len(self.ids), pair[good] % len(self.ids)


def longest_run(a: str, b: str) -> int:
    """Length of the longest run of a that stands in b, by halving over run lengths."""
    pa_, pb_ = C.prefix_sums(C.code_points(a)), C.prefix_sums(C.code_points(b))
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if np.isin(C.gram_hashes(pa_, mid), C.gram_hashes(pb_, mid)).any():
            low = mid
        else:
            high = mid - 1
    return low


def _leaks(batches: Iterator[pa.RecordBatch], index: ItemIndex, passage: int, question_gram: int = 4) -> Iterator[pa.RecordBatch]:
    step = max(1, passage - index.overlap)
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        out = []
        for first, held in C.blocks(C.letters_only(x) for x in texts):
            points, offsets = C.joined(held)
            sums = C.prefix_sums(points)
            at, gram = index.numbers(C.gram_hashes(sums, index.gram))
            owner = np.searchsorted(offsets, at, side="right") - 1
            inside = at + index.gram <= offsets[owner + 1]
            at, gram, owner = at[inside], gram[inside], owner[inside]
            # Passage k of a text covers [k * step, k * step + passage), so a gram stands in one or more of them.
            base = np.concatenate([[0], np.cumsum(-(-(offsets[1:] - offsets[:-1]) // step))]).astype(np.int64)
            local = at - offsets[owner]
            last, least = local // step, np.maximum(0, -((passage - index.gram - local) // step))
            hits = [(base[owner] + last, gram)]
            for back in range(1, -(-passage // step) + 1):
                more = last - back >= least
                if not more.any():
                    break
                hits.append((base[owner[more]] + last[more] - back, gram[more]))
            found, item = index.retrieve(np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits]))
            pairs = {(int(k), int(i)) for k, i in zip(np.searchsorted(base, found, side="right") - 1, item)}
            pairs |= index.short_items(sums, offsets)
            for k, i in pairs:
                run = longest_run(index.texts[i], held[k])
                if run >= index.need[i]:
                    q = index.questions[i]
                    parts = {q[j : j + question_gram] for j in range(max(1, len(q) - question_gram + 1))} if q else set()
                    asked = sum(x in held[k] for x in parts) / len(parts) if parts else 0.0
                    out.append((ids[first + k], index.ids[i], run / len(index.texts[i]), asked))
        if out:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], names=["doc_id", "item_id", "passage_share", "question_share"])


def leaked_items(documents: DataFrame, items: DataFrame, share: float = SHARE, part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, passage_share (longest run over the passage's length), question_share; one row a pair.

    documents: doc_id, text. items: item_id, passage, question; read to the driver part by part.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").alias("id"), "text").where(F.length("text") > 0)
    wanted = items.select("item_id", "passage", "question").where("passage is not null")
    size = wanted.agg(F.coalesce(F.sum(F.length("passage") + F.coalesce(F.length("question"), F.lit(0))), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_chars))
    part_of = F.pmod(F.xxhash64("item_id", "passage"), F.lit(parts))
    found = None
    for k in range(parts):
        rows = wanted.where(part_of == k).toPandas()
        index = ItemIndex(rows.item_id.tolist(), rows.passage.tolist(), rows.question.tolist(), share)
        sent, passage = spark.sparkContext.broadcast(index), max(PASSAGE, 4 * index.overlap)
        one = texts.mapInArrow(lambda it, sent=sent, passage=passage: _leaks(it, sent.value, passage), "doc_id long, item_id long, passage_share double, question_share double")
        if parts > 1:
            one = C.cut(one)
            sent.destroy()
        found = one if found is None else found.union(one)
    return found.groupBy("doc_id", "item_id").agg(F.max("passage_share").alias("passage_share"), F.max("question_share").alias("question_share"))
