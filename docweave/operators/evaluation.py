"""Golden-set evaluation: evidence spans, overlap and similarity joins, outcomes, summaries and experiment arms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import dot, unit
from .spreading import sums_before

OUTCOMES = ("hit", "retrieval_miss", "extraction_miss", "unanswerable", "unscorable")
HIT = 0.5
PART_GRAM, PART_WINDOW = 12, 13
BUCKET = 512
#: Characters of a document in one group of held_quotes at least, and those looked through at once.
ROOM, WINDOW = 1 << 20, 1 << 16
#: Quotes that are looked for one by one: up to so many at a time, and all that are longer.
FEW, LONG = 48, 4096


def evidence_span(text: Column, quote: Column, line_start: Column, line_end: Column) -> Column:
    """struct(start, end): the quote inside its recorded lines, else its first occurrence; null without any. Lines are clamped to the text."""
    lines = F.split(text, "\n")
    count = F.size(lines)
    first, last = F.least(F.greatest(line_start, F.lit(1)), count), F.least(F.greatest(line_end, F.lit(1)), count)
    before = F.when(first > 1, F.length(F.array_join(F.slice(lines, F.lit(1), first - 1), "\n")) + 1).otherwise(0)
    inside = F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(1))), "\n")
    local = T.find(inside, quote)
    start = F.coalesce(before + local, T.find(text, quote))
    return F.when(start.isNotNull(), F.struct(start.cast("long").alias("start"), (start + F.length(quote)).cast("long").alias("end")))


def overlap_pairs(left: DataFrame, right: DataFrame, scope: list[str], bucket: int = BUCKET) -> DataFrame:
    """Pairs of spans (a_id, s, e) and (b_id, s, e) of one scope that share at least half of the shorter.

    Both sides are laid over buckets of positions and joined on (scope, bucket); a pair is kept in the bucket where
    the shared part begins, so every pair comes once and no scope is compared all with all.
    """
    spread = lambda df, i: df.where("e > s").select(*scope, i, "s", "e", F.explode(F.sequence(F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket))).alias("bucket"))
    a = spread(left, "a_id").withColumnsRenamed({"s": "a_s", "e": "a_e"})
    b = spread(right, "b_id").withColumnsRenamed({"s": "b_s", "e": "b_e"})
    begin, end = F.greatest("a_s", "b_s"), F.least("a_e", "b_e")
    shorter = F.least(F.col("a_e") - F.col("a_s"), F.col("b_e") - F.col("b_s"))
    joined = a.join(b, [*scope, "bucket"])
    return joined.where((end > begin) & (2 * (end - begin) >= shorter) & (F.col("bucket") == F.floor(begin / bucket))).select(*scope, "a_id", "b_id", (end - begin).alias("shared"))


def similar_pairs(left: DataFrame, right: DataFrame, scope: list[str], threshold: float) -> DataFrame:
    """Pairs (a_id, b_id) of one scope with a cosine of at least the threshold. Sides: scope, id column, vector."""
    a = left.where("vector is not null").withColumn("u", unit(F.col("vector"))).drop("vector")
    b = right.where("vector is not null").withColumn("v", unit(F.col("vector"))).drop("vector")
    return a.join(b, scope).withColumn("score", F.round(dot(F.col("u"), F.col("v")), 6)).where(F.col("score") >= threshold).drop("u", "v")


def question_outcomes(items: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, recall, outcome. items: question_id, cited, in_graph; questions: question_id, answerable.

    hit from a recall of one half on; else a retrieval miss if any item not cited is in the graph, else an extraction miss.
    """
    per = items.groupBy("question_id").agg(F.avg(F.col("cited").cast("int")).alias("recall"), F.bool_or(~F.col("cited") & F.col("in_graph")).alias("held"))
    outcome = (
        F.when(~F.col("answerable"), "unanswerable")
        .when(F.col("recall").isNull(), "unscorable")
        .when(F.col("recall") >= HIT, "hit")
        .when(F.col("held"), "retrieval_miss")
        .otherwise("extraction_miss")
    )
    return questions.join(per, "question_id", "left").select(*questions.columns, "recall", outcome.alias("outcome"))


def outcome_summary(scored: DataFrame, by: list[str] = ()) -> DataFrame:
    """One row (for each of `by`): a count for each outcome, zeros included, the number scored, the hit rate and the mean recall."""
    is_scored = F.col("outcome").isin("hit", "retrieval_miss", "extraction_miss")
    n, hits = F.count_if(is_scored), F.count_if(F.col("outcome") == "hit")
    return scored.groupBy(*by).agg(
        *(F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES), n.alias("scored"), F.round(F.when(n > 0, hits / n), 6).alias("hit_rate"), F.round(F.avg(F.when(is_scored, F.col("recall"))), 6).alias("mean_recall")
    )


def probe_summary(missed: DataFrame, passages: DataFrame, found: DataFrame) -> DataFrame:
    """One row: of the missed questions (question_id) how many a second extraction recovers, still misses, or cannot be located.

    passages: question_id, chunk_id, a_id, s, e; found: chunk_id, b_id, s, e, what the second extraction cites. A question
    is recovered from a recall of one half on.
    """
    own = passages.join(missed, "question_id", "left_semi")
    hit = overlap_pairs(own.select("chunk_id", "a_id", "s", "e"), found, ["chunk_id"]).select("a_id").distinct().withColumn("hit", F.lit(True))
    recall = own.join(hit, "a_id", "left").groupBy("question_id").agg(F.avg(F.coalesce("hit", F.lit(False)).cast("int")).alias("recall"))
    r = F.col("recall")
    return missed.join(recall, "question_id", "left").agg(F.count("*").alias("probed"), F.count_if(r >= HIT).alias("recovered"), F.count_if(r < HIT).alias("still_missed"), F.count_if(r.isNull()).alias("not_locatable"))


def by_question_type(scored: DataFrame) -> DataFrame:
    is_scored = F.col("outcome").isin("hit", "retrieval_miss", "extraction_miss")
    return scored.groupBy(F.coalesce("question_type", F.lit("unknown")).alias("question_type")).agg(F.count_if(is_scored).alias("scored"), F.count_if(F.col("outcome") == "hit").alias("hits"))


def _gram_hashes(text: str, width: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(points) - width + 1
    h = np.full(max(n, 0), width, dtype=np.uint64)
    for j in range(width if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + points[j : j + n]
        h ^= h >> np.uint64(31)
    return h


def _part_key(part: str) -> int:
    h = _gram_hashes(part, min(len(part), PART_GRAM))
    return int(h[:PART_WINDOW].min().astype(np.int64))


def _text_keys(text: str, short: list[int]) -> np.ndarray:
    """Keys under which parts of the text are filed: minimizers, and all grams of the widths of short parts."""
    h = _gram_hashes(text, PART_GRAM)
    keys = [np.lib.stride_tricks.sliding_window_view(h, PART_WINDOW).min(axis=1)] if len(h) >= PART_WINDOW else []
    for n in short:
        own = _gram_hashes(text, min(n, PART_GRAM))
        width = max(1, n - PART_GRAM + 1)
        keys.append(np.lib.stride_tricks.sliding_window_view(own, width).min(axis=1) if len(own) >= width else own[:0])
    return np.unique(np.concatenate(keys)) if keys else h[:0]


def containing_texts(parts: DataFrame, texts: DataFrame, scope: str) -> DataFrame:
    """part_id, text_id, at (from 0, the first place) of texts that hold a part (scope, part_id, part; scope, text_id, text) of their scope.

    A part is filed under the least hash of its first grams, a text under the least of every window of as many grams, so
    a text that holds a part shares its key; a seventh of a text's grams are keys. Parts shorter than a window are filed
    by the window they fill. What meets is compared.
    """
    full = PART_GRAM + PART_WINDOW - 1
    known = parts.where(F.length("part") > 0).select(F.col(scope).alias("scope"), "part_id", "part")
    short = known.where(F.length("part") < full).groupBy("scope").agg(F.collect_set(F.length("part")).alias("short"))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = np.array([_part_key(x) for x in b.column("part").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("scope"), b.column("part_id"), pa.array(keys)], names=["scope", "part_id", "key"])

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_text_keys(x, s or []) for x, s in zip(b.column("text").to_pylist(), b.column("short").to_pylist())]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
            every = np.concatenate(keys).view(np.int64) if keys else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b.column("scope").take(at), b.column("text_id").take(at), pa.array(every)], names=["scope", "text_id", "key"])

    own = texts.where(F.length("text") > 0).select(F.col(scope).alias("scope"), "text_id", "text")
    a = known.mapInArrow(filed, "scope string, part_id long, key long")
    b = own.join(known.select("scope").distinct(), "scope", "left_semi").join(short, "scope", "left").mapInArrow(held, "scope string, text_id long, key long")
    near = a.join(b, ["scope", "key"]).select("part_id", "text_id").distinct()
    met = near.join(known.select("part_id", "part"), "part_id").join(own.select("text_id", "text"), "text_id")
    return met.withColumn("at", T.find(F.col("text"), F.col("part"))).where("at is not null").select("part_id", "text_id", "at").distinct()


def _doubled(text: str) -> Iterator[np.ndarray]:
    """Hashes of the runs of 1, 2, 4, ... characters at every place."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while len(h):
        yield h
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:] if len(h) > width else h[:0]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        width *= 2


class _Quotes:
    """Quotes by the hashes of their first and last run of the greatest power of two that fits; together the runs cover the quote."""

    def __init__(self, quotes: list[str]):
        self.quotes, self.size = quotes, np.array([len(q) for q in quotes])
        start, level = np.cumsum(self.size) - self.size, np.frexp(self.size)[1] - 1
        bits = min(22, max(16, 5 + len(quotes).bit_length()))
        self.shift, self.levels = np.uint64(64 - bits), {}
        self.last = np.zeros(len(quotes), dtype=np.uint64)
        for k, h in zip(range(level.max() + 1), _doubled("".join(quotes))):
            own = np.flatnonzero(level == k)
            if len(own):
                self.last[own] = h[start[own] + self.size[own] - (1 << k)]
                first = h[start[own]]
                order = np.argsort(first, kind="stable")
                keys, begin, count = np.unique(first[order], return_index=True, return_counts=True)
                maybe = np.zeros(1 << bits, dtype=bool)
                maybe[keys >> self.shift] = True
                self.levels[k] = maybe, keys, begin, begin + count, own[order]

    def within(self, text: str) -> set[int]:
        """Numbers of the quotes that stand in the text."""
        place = np.full(len(self.quotes), -1)
        for k, h in zip(range(max(self.levels) + 1), _doubled(text)):
            if k not in self.levels:
                continue
            maybe, keys, begin, end, own = self.levels[k]
            at = np.flatnonzero(maybe[h >> self.shift])
            i = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
            met = keys[i] == h[at]
            at, now, stop = at[met], begin[i[met]], end[i[met]]
            while len(at):
                q = own[now]
                tail = at + self.size[q] - (1 << k)
                fits = np.flatnonzero(tail < len(h))
                fits = fits[h[tail[fits]] == self.last[q[fits]]]
                place[q[fits]] = at[fits]
                more = now + 1 < stop
                at, now, stop = at[more], now[more] + 1, stop[more]
        return {i for i in np.flatnonzero(place >= 0).tolist() if text.startswith(self.quotes[i], place[i]) or self.quotes[i] in text}


class _Lookup:
    """Looks for quotes in the pieces of a text, which come in order."""

    def __init__(self):
        self.short, self.long, self.most, self.held, self.size, self.index = [], [], 0, [], 0, None

    def quote(self, quote: str) -> None:
        (self.long if len(quote) > LONG else self.short).append(quote)
        self.most = max(self.most, len(quote))

    def piece(self, text: str) -> list[str]:
        """The quotes found, of which some may be known only with a later piece."""
        if not self.short and not self.long:
            return []
        self.held.append(text)
        self.size += len(text) + 2
        return self.rest() if self.size >= max(WINDOW, 3 * self.most) else []

    def rest(self) -> list[str]:
        text = "\n\n".join(self.held)
        found = [q for q in self.long if q in text]
        if len(self.short) <= FEW:
            found += [q for q in self.short if q in text]
        else:
            for at in range(0, len(text), WINDOW):
                if self.index is None or 2 * len(self.short) < len(self.index.quotes):
                    self.index = _Quotes(self.short)
                met = {self.index.quotes[i] for i in self.index.within(text[at : at + WINDOW + LONG])}
                found += [q for q in self.short if q in met]
                self.short = [q for q in self.short if q not in met]
                if not self.short:
                    break
        gone = set(found)
        self.short, self.long = [q for q in self.short if q not in gone], [q for q in self.long if q not in gone]
        tail = text[max(0, len(text) - self.most + 1) :]
        self.held, self.size = [tail], len(tail)
        return found


def _looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """scope, quote of rows in the order of scope, group and place; a group's quotes come before its texts."""
    group, lookup = None, _Lookup()
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.string()), pa.array([q for _, q in rows], pa.string())], names=["scope", "quote"])
    for b in batches:
        out = []
        for scope, part, at, text in zip(*(b.column(c).to_pylist() for c in ("scope", "group", "at", "text"))):
            if (scope, part) != group:
                out += [(group[0], q) for q in lookup.rest()] if group else []
                group, lookup = (scope, part), _Lookup()
            if at < 0:
                lookup.quote(text)
            else:
                out += [(scope, q) for q in lookup.piece(text)]
        yield batch(out)
    if group:
        yield batch([(group[0], q) for q in lookup.rest()])


def held_quotes(quotes: DataFrame, texts: DataFrame, scope: str, order: str, room: int = ROOM) -> DataFrame:
    """scope, quote, once each: quotes (scope, quote) that stand in the text of their scope, also over the ends of its parts.

    texts: scope, order, text; a scope's text is its parts in order (null last, equal ones by text) with an empty line
    between them. It is laid over groups of at least `room` characters, four times those of its quotes or its longest part,
    which overlap by the longest quote; each has all quotes of the scope and looks for all of them at once. So neither is a
    whole text in one row or task, nor is it read once a quote.
    """
    place = F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)).alias("place")
    parts = texts.where(F.col(scope).isNotNull()).select(F.col(scope).alias("scope"), place, F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text") + F.lit(2).cast("long"))
    sizes = parts.groupBy("scope", "place").agg(F.sum("n").alias("n"), F.max("n").alias("longest"))
    whole = sizes.groupBy("scope").agg(F.sum("n").alias("whole"), F.max("longest").alias("longest"))
    sought = quotes.where(F.length("quote") > 0).select(F.col(scope).alias("scope"), "quote").distinct()
    limits = sought.join(whole, "scope").where(F.length("quote") <= F.col("whole")).groupBy("scope").agg(F.max(F.length("quote")).alias("most"), F.sum(F.length("quote")).alias("chars"), F.max("whole").alias("whole"), F.max("longest").alias("longest"))
    limits = limits.select("scope", "most", "whole", F.greatest(F.lit(room), 4 * F.col("chars"), "longest").alias("span"))
    bases = sums_before(sizes.select("scope", "place", "n"), "scope", "place", "n", "base").select("scope", "place", "base").join(limits.select("scope", "most", "span"), "scope")
    before = Window.partitionBy("scope", "place").orderBy("text").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(bases, ["scope", "place"]).withColumn("at", F.col("base") + F.col("before"))
    groups = F.sequence(F.floor(F.greatest(F.col("at") - F.col("most") + 1, F.lit(0)) / F.col("span")), F.floor((F.col("at") + F.col("n") - 1) / F.col("span")))
    laid = placed.select("scope", F.explode(groups).alias("group"), "at", "text")
    every = F.sequence(F.lit(0).cast("long"), F.floor((F.col("whole") - 1) / F.col("span")))
    copied = sought.join(limits, "scope").where(F.length("quote") <= F.col("whole")).select("scope", F.explode(every).alias("group"), F.lit(-1).cast("long").alias("at"), F.col("quote").alias("text"))
    rows = laid.union(copied).repartition("scope", "group").sortWithinPartitions("scope", "group", "at")
    return rows.mapInArrow(_looked_up, "scope string, quote string").distinct().withColumnRenamed("scope", scope)


def anchored(quotes: DataFrame, texts: DataFrame, scope: str) -> DataFrame:
    """quotes with start and end in their document, the first place where the quote stands; null where it is in none of the document's texts.

    quotes: scope, quote; texts: scope, text_id, text, base (the place of the text in the document). A quote is looked up
    once however many rows have it; one that runs over the end of a text is not found.
    """
    once = quotes.where(F.length("quote") > 0).select(scope, "quote").distinct().withColumn("part_id", F.xxhash64(scope, "quote"))
    found = containing_texts(once.select(scope, "part_id", F.col("quote").alias("part")), texts.select(scope, "text_id", "text"), scope)
    first = found.join(texts.select("text_id", "base"), "text_id").groupBy("part_id").agg(F.min(F.col("base") + F.col("at")).alias("start"))
    placed = quotes.withColumn("part_id", F.xxhash64(scope, "quote")).join(first, "part_id", "left").drop("part_id")
    return placed.withColumn("end", F.col("start") + F.length("quote"))


def answer_facts(facts: Column, answer: Column) -> Column:
    """Objects of the answer's facts (array of struct with `object`), else the answer itself, else nothing."""
    objects = F.filter(F.transform(F.coalesce(facts, F.array().cast("array<struct<subject:string,predicate:string,object:string>>")), lambda x: x["object"]), lambda x: F.coalesce(x != "", F.lit(False)))
    whole = F.when(F.coalesce(answer != "", F.lit(False)), F.array(answer)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(objects) > 0, objects).otherwise(whole)


def judged(questions: DataFrame, verdicts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, answerable of questions (key, question, context): without context not answerable and not asked.

    verdicts: asked rows to key, answerable; a question without verdict is null.
    """
    asks = F.coalesce(F.col("context") != "", F.lit(False))
    asked = verdicts(questions.where(asks))
    told = questions.withColumn("asks", asks).join(asked.select("key", F.col("answerable").alias("told")), "key", "left")
    return told.select("key", F.when(~F.col("asks"), F.lit(False)).otherwise(F.col("told")).alias("answerable"))


def score_readings(questions: DataFrame, parts: DataFrame, readings: list[str]) -> DataFrame:
    """question_id, reading, recall, outcome: the golden questions under each reading.

    parts: question_id, reading, part_id, cited, in_graph; the passages of a question under the strict and the semantic
    reading, the facts of its answer under the answer reading. A question without parts is unscorable under it.
    """
    out = None
    for reading in readings:
        own = parts.where(F.col("reading") == reading)
        scored = question_outcomes(own, questions).withColumn("reading", F.lit(reading))
        out = scored if out is None else out.union(scored)
    return out


def occurrences(text: Column, part: Column) -> Column:
    """Occurrences that do not overlap; 0 for an empty part."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)


def pairwise_jaccard(sets: DataFrame, scope: list[str], run: str, names: str) -> DataFrame:
    """Mean Jaccard similarity of the runs' name sets (arrays) over all pairs of runs of a scope; two empty sets are alike."""
    a, b = (sets.select(*scope, F.col(run).alias(f"run_{x}"), F.col(names).alias(f"names_{x}")) for x in "ab")
    union = F.size(F.array_union("names_a", "names_b"))
    score = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("names_a", "names_b")) / union)
    return a.join(b, scope).where("run_a < run_b").groupBy(*scope).agg(F.round(F.avg(score), 6).alias("stability"))


def arm_verdicts(scores: DataFrame, control: str = "control", least_gain: int = 4) -> DataFrame:
    """Per arm: hits, gain over the mean of the control runs, answers every control run has and the arm loses, verdict.

    scores: arm, run, question_id, hit.
    """
    runs = scores.groupBy("arm", "run").agg(F.count_if("hit").alias("hits"))
    base = runs.where(F.col("arm") == control).agg(F.avg("hits").alias("control_mean"), F.count("*").alias("n_controls"))
    always = scores.where((F.col("arm") == control) & F.col("hit")).groupBy("question_id").agg(F.countDistinct("run").alias("k"))
    always = always.crossJoin(F.broadcast(base)).where("k = n_controls").select("question_id")
    arms = scores.where(F.col("arm") != control)
    lost = arms.where(~F.col("hit")).join(always, "question_id", "left_semi").groupBy("arm", "run").agg(F.count("*").alias("lost"))
    joined = runs.where(F.col("arm") != control).join(lost, ["arm", "run"], "left").fillna(0, ["lost"]).crossJoin(F.broadcast(base))
    gain = F.col("hits") - F.col("control_mean")
    return joined.select("arm", "run", "hits", F.round(gain, 6).alias("gain"), "lost", ((gain >= least_gain) & (F.col("lost") == 0)).alias("adopt"))


def latest(rows: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """The values of the row appended last for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("v")).select(*keys, "v.*")


def renumbered(questions: DataFrame, scope: list[str], order: str) -> DataFrame:
    """Contiguous ids q001, q002, ... after dropping questions equal up to case and white space, first wins."""
    keyed = questions.withColumn("key", T.question_key(F.col("question")))
    rest = [c for c in questions.columns if c not in scope]
    once = keyed.groupBy(*scope, "key").agg(F.min_by(F.struct(*rest), order).alias("q")).select(*scope, "q.*")
    k = F.row_number().over(Window.partitionBy(*scope).orderBy(order))
    return once.withColumn("new_id", F.format_string("q%03d", k))


#: Kinds of golden questions.
QUESTION_TYPES = ("entity", "attribute", "relation", "multi_hop", "list", "boolean", "unanswerable")


def question_problems(questions: DataFrame, expected: DataFrame, scope: list[str]) -> DataFrame:
    """scope, position, problem of generated questions: `count` (no position), `text`, `type`, `duplicate` of an earlier one up to case and spaces.

    questions: scope, position, question, question_type; expected: scope, n.
    """
    counted = expected.join(questions.groupBy(*scope).agg(F.count("*").alias("given")), scope, "left").where(F.coalesce("given", F.lit(0)) != F.col("n"))
    count = counted.select(*scope, F.lit(None).cast("long").alias("position"), F.lit("count").alias("problem"))
    q = questions.select(*scope, F.col("position").cast("long").alias("position"), "question", "question_type")
    empty = ~F.coalesce(F.col("question") != "", F.lit(False))
    text = q.where(empty).select(*scope, "position", F.lit("text"))
    kind = q.where(~F.coalesce(F.col("question_type").isin(*QUESTION_TYPES), F.lit(False))).select(*scope, "position", F.lit("type"))
    keyed = q.where(~empty).withColumn("key", T.question_key(F.col("question")))
    first = keyed.groupBy(*scope, "key").agg(F.min("position").alias("first"))
    again = keyed.join(first, [*scope, "key"]).where("position > first").select(*scope, "position", F.lit("duplicate"))
    return count.union(text).union(kind).union(again)


def matched_answers(questions: DataFrame, answers: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """questions with their answers by key, the last of repeated ones. Raises where the keys of the two are not the same."""
    values = [c for c in answers.columns if c not in (*keys, seq)]
    last = latest(answers, keys, seq, values)
    asked = questions.select(*keys).distinct()
    apart = asked.join(last.select(*keys), keys, "left_anti").limit(1).collect() or last.select(*keys).join(asked, keys, "left_anti").limit(1).collect()
    if apart:
        raise ValueError(f"answers and questions differ at {tuple(apart[0])}")
    return questions.join(last, keys)


def scoring_report(scored: DataFrame) -> DataFrame:
    """part, name, line: shares of the outcomes, hits by question type, and one line a question.

    scored: question_id, question_type, recall, outcome.
    """
    total = F.sum("n").over(Window.partitionBy("part"))
    outcomes = scored.groupBy(F.lit("outcome").alias("part"), F.col("outcome").alias("name")).agg(F.count("*").alias("n"))
    share = F.format_string("%d (%.1f %%)", F.col("n"), F.col("n") * 100.0 / total)
    kinds = by_question_type(scored).select(F.lit("type").alias("part"), F.col("question_type").alias("name"), F.format_string("%d/%d", "hits", "scored").alias("line"))
    recall = F.when(F.col("recall").isNull(), "-").otherwise(F.format_string("%.2f", F.col("recall")))
    each = scored.select(F.lit("question"), "question_id", F.concat_ws(" ", "outcome", recall))
    return outcomes.select("part", "name", share.alias("line")).union(kinds).union(each)


#: What each stage of an evaluation needs of a document.
STAGE_NEEDS = {"generate": ("text",), "schema": ("text", "chunks"), "reextract": ("chunks", "graph", "active version"), "score": ("text", "golden set", "graph")}


def readiness(stems: DataFrame, held: dict[str, DataFrame]) -> DataFrame:
    """stem, stage, problem: what is missing of each document for each stage. held: for each need the stems that have it."""
    has = None
    for need, rows in held.items():
        own = rows.select("stem", F.lit(need).alias("need")).distinct()
        has = own if has is None else has.union(own)
    wanted = F.explode(F.array(*(F.struct(F.lit(stage).alias("stage"), F.lit(n).alias("need")) for stage, needs in STAGE_NEEDS.items() for n in needs))).alias("w")
    due = stems.select("stem").distinct().select("stem", wanted).select("stem", "w.stage", "w.need")
    return due.join(has, ["stem", "need"], "left_anti").select("stem", "stage", F.concat(F.lit("no "), "need").alias("problem"))
