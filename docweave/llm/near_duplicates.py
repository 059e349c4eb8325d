"""Problem 3: near-duplicate records with small edits, insertions or reordering.

Method: each text becomes a fingerprint of 256 bits, one bit of each of 256 min-hashes over its character runs, whose
Hamming distance falls with the share of text in common. Fingerprints are partitioned into shards: bands of min-hashes
give the outer shards, and a shard with more than CAP members is split again and again by the Hamming distance to a
vantage point; members within the search radius of the boundary go to both sides (owners on their own side, guests on
the other). In each shard a vantage-point tree answers, for every owner, which members lie within the radius, pruning
branches by the triangle inequality. A vantage-point tree over all fingerprints alone would not prune: the distances of
unrelated texts to any vantage point lie close together and the radius is wider than their spread; hence the bands.
A shard that splitting does not make smaller is compared in blocks, so none is cut short. A second bit of each min-hash
then leaves out pairs that only many single bits made look alike, and the rest is checked exactly on the whole texts.

What two texts have in common counts where it stands in runs of RUN characters or more. Texts of one language also have
many short runs in common by chance, a third of their length in runs of LONG_RUN at most; edits scattered at random
that leave 0.7 of a text in runs of RUN leave half of it in runs of LONG_RUN. So LONG_SHARE must stand in those as well.

Names are searched the same way, with the edit distance of the letters as metric and day and plan as outer shards.
Bracketed marks are dropped where they stand in brackets; those that make up at least MARK_SHARE of all marks of the
table (hence at most 1 / MARK_SHARE of them) are dropped without brackets as well.

Rows equal up to normalization are one class until the end. Null and empty texts, and names or dates without content,
match nothing. Texts shorter than one run are compared as a whole. Only the named columns are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# Scattered edits break runs of GRAM far more than characters: at a share of 0.7 by many single edits, texts of 4-runs are
# still about half alike, of 9-runs a quarter.
GRAM = 4
BINS = 256
ROWS = 4
BANDS = 56
RADIUS = 76
CAP = 1500
ROUNDS = 6
SHARE = 0.7
RUN = 10
LONG_RUN, LONG_SHARE = 16, 0.45
EDITS = 2
MARK_SHARE = 0.001
#: Of the 256 min-hashes so many must agree in both bits: 128 of them would by chance where a third are the same.
AGREE = 144
WORDS = ["w0", "w1", "w2", "w3"]
SECOND = ["v0", "v1", "v2", "v3"]


# Vantage-point trees ------------------------------------------------------------------------------------------------


class VantageTree:
    """Exact range search under a metric. distance(i, others) gives the distances of member i to an index array."""

    LEAF = 24

    def __init__(self, n: int, distance: Callable[[int, np.ndarray], np.ndarray]):
        self.distance = distance
        self.nodes: list[tuple] = []
        self.root = self._build(np.arange(n))

    def _build(self, members: np.ndarray) -> int:
        if len(members) <= self.LEAF:
            self.nodes.append((None, members, 0, -1, -1))
            return len(self.nodes) - 1
        vantage, rest = int(members[0]), members[1:]
        d = self.distance(vantage, rest)
        border = int(np.median(d))
        near = d <= border
        if near.all():
            self.nodes.append((None, members, 0, -1, -1))
            return len(self.nodes) - 1
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (vantage, None, border, self._build(rest[near]), self._build(rest[~near]))
        return at

    def within(self, q: int, radius: int) -> list[int]:
        out: list[int] = []
        stack = [self.root]
        while stack:
            vantage, leaf, border, near, far = self.nodes[stack.pop()]
            if vantage is None:
                if len(leaf):
                    out += leaf[self.distance(q, leaf) <= radius].tolist()
                continue
            d = int(self.distance(q, np.array([vantage]))[0])
            if d <= radius:
                out.append(vantage)
            if d - radius <= border:
                stack.append(near)
            if d + radius > border:
                stack.append(far)
        return out


def hamming_metric(prints: list[tuple[int, ...]]) -> Callable[[int, np.ndarray], np.ndarray]:
    words = np.array([[(x >> (64 * k)) & C.MASK for k in range(len(WORDS))] for x, *_ in prints], dtype=np.uint64)
    return lambda i, idx: np.bitwise_count(words[idx] ^ words[i]).sum(axis=1, dtype=np.int64)


def edit_metric(names: list[str]) -> Callable[[int, np.ndarray], np.ndarray]:
    size = np.array([len(x) for x in names])
    grid = np.zeros((len(names), max(1, int(size.max(initial=1)))), dtype=np.int64)
    for k, x in enumerate(names):
        grid[k, : len(x)] = [ord(c) for c in x]

    def distance(i: int, idx: np.ndarray) -> np.ndarray:
        rows, own = grid[idx], names[i]
        last = np.tile(np.arange(rows.shape[1] + 1), (len(idx), 1))
        for k, c in enumerate(own, 1):
            now = np.empty_like(last)
            now[:, 0] = k
            swap = last[:, :-1] + (rows != ord(c))
            drop = last[:, 1:] + 1
            best = np.minimum(swap, drop)
            for j in range(rows.shape[1]):
                now[:, j + 1] = np.minimum(best[:, j], now[:, j] + 1)
            last = now
        return last[np.arange(len(idx)), size[idx]]

    return distance


def one_hamming(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    return (a[0] ^ b[0]).bit_count()


def agree(a: tuple[int, int], b: tuple[int, int]) -> bool:
    """Enough min-hashes are equal in both of their bits."""
    return BINS - ((a[0] ^ b[0]) | (a[1] ^ b[1])).bit_count() >= AGREE


def one_edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def shard_pairs(ids: list[int], values: list, owner: list[bool], radius: int, one: Callable, many: Callable, also: Callable | None = None) -> Iterator[tuple[int, int]]:
    """Pairs (smaller id, larger id) within the radius with at least one owner, of which `also` holds."""
    n = len(ids)
    if n <= VantageTree.LEAF:
        for i in range(n):
            for j in range(i + 1, n):
                if (owner[i] or owner[j]) and ids[i] != ids[j] and one(values[i], values[j]) <= radius and (also is None or also(values[i], values[j])):
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])
        return
    tree = VantageTree(n, many(values))
    for i in range(n):
        if owner[i]:
            for j in tree.within(i, radius):
                if (ids[j] > ids[i] or (not owner[j] and ids[j] != ids[i])) and (also is None or also(values[i], values[j])):
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])


def _search(batches: Iterator[pa.RecordBatch], radius: int, one: Callable, many: Callable, read: Callable, also: Callable | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard: shard, id, owner and the value's columns. A shard has at most CAP rows or two blocks of them."""
    held: list[tuple] = []
    found: set[tuple[int, int]] = set()

    def flush() -> None:
        if len(held) > 1:
            ids, owner, values = zip(*held)
            found.update(shard_pairs(list(ids), list(values), list(owner), radius, one, many, also))
        held.clear()

    def out() -> pa.RecordBatch:
        a, b = zip(*found) if found else ((), ())
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    shard = None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in batch.schema.names}
        for s, i, o, v in zip(c["shard"], c["id"], c["owner"], read(c)):
            if s != shard:
                flush()
                shard = s
                if len(found) > 50_000:
                    yield out()
            held.append((i, o, v))
    flush()
    yield out()


def _prints(c: dict) -> list[tuple[int, int]]:
    whole = lambda names: [sum((w & C.MASK) << (64 * k) for k, w in enumerate(ws)) for ws in zip(*(c[w] for w in names))]
    return list(zip(whole(WORDS), whole(SECOND)))


def range_pairs(
    shards: DataFrame, points: DataFrame, radius: int, distance: Callable[[str, str], Column], one: Callable, many: Callable, read: Callable, cap: int = CAP, rounds: int = ROUNDS, also: Callable | None = None,
) -> DataFrame:
    """Distinct pairs a < b of ids within `radius` that share a shard. shards: shard LONG, id LONG. points: id and the value columns.

    distance(prefix_a, prefix_b) is the metric as a Column over value columns with those prefixes. Most shards have one
    member, so values are joined only to the memberships that can pair.
    """
    values = [c for c in points.columns if c != "id"]
    columns = ["shard", "id", "owner", *values]
    # One exchange serves both sides: the sizes are counted where the memberships already lie.
    placed = shards.repartition("shard")
    shared = C.cut(placed.join(placed.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1"), "shard").select("shard", "id", "n"))
    filled = lambda x: shared.where(x).join(points, "id").withColumn("owner", F.lit(True)).select(columns)
    ready = filled(F.col("n") <= cap)
    hot = C.cut(filled(F.col("n") > cap)) if not shared.where(F.col("n") > cap).isEmpty() else None
    for k in range(rounds):
        if hot is None or hot.isEmpty():
            hot = None
            break
        first = F.min_by(F.struct(*values), F.xxhash64("id", F.lit(k)))
        vantage = hot.groupBy("shard").agg(first.alias("v"))
        measured = hot.join(vantage, "shard").select("*", *(F.col(f"v.{x}").alias(f"v_{x}") for x in values)).withColumn("d", distance("", "v_"))
        border = measured.groupBy("shard").agg(F.percentile_approx("d", 0.5).alias("m"))
        placed = C.cut(measured.join(border, "shard"))
        side = lambda k_, s: F.xxhash64("shard", F.lit(k_), F.lit(s)).alias("shard")
        inner = placed.where(F.col("d") <= F.col("m") + radius).select(side(k, 0), "id", (F.col("owner") & (F.col("d") <= F.col("m"))).alias("owner"), *values)
        outer = placed.where((F.col("d") > F.col("m")) | (~F.col("owner") & (F.col("d") > F.col("m") - radius))).select(side(k, 1), "id", "owner", *values)
        both = inner.union(outer)
        counts = both.groupBy("shard").agg(F.count("*").alias("n"), F.count_if("owner").alias("owners")).where("owners > 0")
        both = C.cut(both.join(counts, "shard"))
        ready = ready.union(both.where(F.col("n") <= cap).select(columns))
        hot = both.where(F.col("n") > cap).select(columns)
    if hot is not None and not hot.isEmpty():
        count = hot.groupBy("shard").agg(F.ceil(F.count("*") / (cap // 2)).cast("int").alias("k"))
        block = hot.join(count, "shard").withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
        as_owner = block.where("owner").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        as_guest = block.withColumnRenamed("i", "j").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        place = F.xxhash64("shard", F.lit("block"), "i", "j").alias("shard")
        ready = ready.union(as_owner.select(place, "id", F.lit(True).alias("owner"), *values)).union(as_guest.select(place, "id", F.lit(False).alias("owner"), *values))
    return (
        ready.select(columns)
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(lambda it: _search(it, radius, one, many, read, also), "a long, b long")
        .distinct()
    )


# Texts --------------------------------------------------------------------------------------------------------------


def _signatures(batches: Iterator[pa.RecordBatch], gram: int, bins: int, rows: int, n_bands: int) -> Iterator[pa.RecordBatch]:
    width = np.uint64(64 - bins.bit_length() + 1)
    # A bin left empty takes the value of another bin in a fixed random order, the same for every text.
    order = np.random.default_rng(7).permuted(np.tile(np.arange(bins), (bins, 1)), axis=1)
    for batch in batches:
        ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
        out: list[tuple] = []
        for first, held in C.blocks(C.compact(x) for x in texts):
            points, offsets = C.joined(held)
            hashes = C.gram_hashes(C.prefix_sums(points), gram)
            for j, text in enumerate(held):
                if not text:
                    continue
                h = hashes[offsets[j] : max(offsets[j], offsets[j + 1] - gram + 1)]
                if not len(h):
                    h = np.array([xxhash.xxh64_intdigest(text)], dtype=np.uint64)
                mins = np.full(bins, C.MASK, dtype=np.uint64)
                np.minimum.at(mins, (h >> width).astype(np.int64), h)
                empty = np.flatnonzero(mins == np.uint64(C.MASK))
                if len(empty):
                    filled = mins != np.uint64(C.MASK)
                    donors = order[empty, filled[order[empty]].argmax(axis=1)]
                    mins[empty] = mins[donors] + empty.astype(np.uint64) * np.uint64(C.BASE)
                mins = C.mix(mins)
                one, two = (np.packbits((mins >> np.uint64(k) & np.uint64(1)).astype(np.uint8)).view(np.int64) for k in (0, 1))
                rows_of = mins[: n_bands * rows].reshape(-1, rows)
                bands = C.mix(rows_of @ C.mix(np.arange(1, rows + 1, dtype=np.uint64)) + np.arange(n_bands, dtype=np.uint64))
                out.append((ids[first + j], _digest(text), np.concatenate([one, two]), (bands >> np.uint64(32)).astype(np.uint32).view(np.int32)))
        if out:
            i, cls, bits, bands = zip(*out)
            words = np.array(bits)
            names = [*WORDS, *SECOND]
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int64()), pa.array(cls, pa.binary()), *(pa.array(words[:, k]) for k in range(len(names))), pa.array(list(bands), pa.list_(pa.int32()))],
                names=["id", "cls", *names, "bands"],
            )


def _digest(compact: str) -> bytes:
    return xxhash.xxh3_128_digest(compact.encode("utf-8", "surrogatepass"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [(i, _digest(x)) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()) if (x := C.compact(t))]
        ids, cls = zip(*held) if held else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(cls, pa.binary())], names=["id", "cls"])


def _covered(n: int, hit: np.ndarray, run: int) -> float:
    """Share of n characters that lie in a run that begins where `hit` holds."""
    upto = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(hit, out=upto[1 : len(hit) + 1])
    upto[len(hit) + 1 :] = upto[len(hit)]
    return float(np.count_nonzero(upto[1:] - np.concatenate([np.zeros(run, dtype=np.int32), upto[1 : n - run + 1]]))) / n


def covered(a: np.ndarray, b: np.ndarray, run: int) -> float:
    """Share of text a (code points) that stands in runs of at least `run` characters also found in b."""
    if len(a) < run or len(b) < run:
        return float(len(a) == len(b) and bool((a == b).all()))
    return _covered(len(a), np.isin(C.gram_hashes(C.prefix_sums(a), run), C.gram_hashes(C.prefix_sums(b), run)), run)


class _Runs:
    """A text's runs of each width asked for: distinct hashes in order, and which of them begins at each position."""

    def __init__(self, text: str):
        self.text = C.compact(text)
        self.sums = C.prefix_sums(C.code_points(self.text))
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.by_width:
            self.by_width[width] = np.unique(C.gram_hashes(self.sums, width), return_inverse=True)
        return self.by_width[width]

    def both_covered(self, other: _Runs, width: int, share: float) -> bool:
        (own, at), (theirs, there) = self.of(width), other.of(width)
        place = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
        same = theirs[place] == own
        if _covered(len(self.text), same[at], width) < share:
            return False
        back = np.zeros(len(theirs), dtype=bool)
        back[place[same]] = True
        return _covered(len(other.text), back[there], width) >= share


def _checked(batches: Iterator[pa.RecordBatch], share: float, run: int, long_run: int, long_share: float) -> Iterator[pa.RecordBatch]:
    runs = lru_cache(maxsize=256)(_Runs)

    def alike(x: str, y: str) -> bool:
        p, q = runs(x), runs(y)
        least = min(len(p.text), len(q.text))
        if least < run:
            return p.text == q.text
        return p.both_covered(q, run, share) and (least < long_run or p.both_covered(q, long_run, long_share))

    for batch in batches:
        keep = [alike(x, y) for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column("a"), batch.column("b"))], names=["a", "b"])


class NearDuplicates:
    """links: pairs a < b of representatives; members: id and rep, the least id of the rows equal up to normalization."""

    def __init__(self, links: DataFrame, members: DataFrame):
        self.links, self.members = links, members

    def pairs(self) -> DataFrame:
        """id_a < id_b of every pair of rows: copies among each other and across linked representatives."""
        m = self.members
        within = C.pairs_within(m, ["rep"], "id").select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))
        x, y = m.select(F.col("rep").alias("a"), F.col("id").alias("x")), m.select(F.col("rep").alias("b"), F.col("id").alias("y"))
        across = self.links.join(x, "a").join(y, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
        return within.union(across)

    def classes(self) -> DataFrame:
        """id, class_id (least id of the connected group), n_links (linked representatives of the row's representative)."""
        both = self.links.select("a", "b").union(self.links.select("b", "a"))
        degree = both.groupBy("a").agg(F.count("*").alias("n_links"))
        label = C.cut(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")))
        while True:
            # The least label among the neighbours, then the label of that label: paths halve in each round.
            near = both.join(label.select(F.col("a").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("l"))
            step = label.join(near, "a").select("a", F.col("label").alias("old"), F.least("label", "l").alias("mid"))
            jump = label.select(F.col("a").alias("mid"), F.col("label").alias("next"))
            new = C.cut(step.join(jump, "mid", "left").select("a", "old", F.least("mid", F.coalesce("next", "mid")).alias("label")))
            label = new.select("a", "label")
            if new.where("label <> old").isEmpty():
                break
        return (
            self.members.join(label.withColumnRenamed("a", "rep"), "rep", "left")
            .join(degree.withColumnRenamed("a", "rep"), "rep", "left")
            .select("id", F.coalesce("label", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        )


def near_duplicate_texts(records: DataFrame, share: float = SHARE, radius: int = RADIUS, cap: int = CAP, run: int = RUN) -> NearDuplicates:
    """records: id LONG, text STRING. Links rows of which at least `share` of each one's text stands in the other."""
    texts = records.select("id", "text").where(F.length("text") > 0)
    words = [*WORDS, *SECOND]
    schema = f"id long, cls binary, {', '.join(f'{w} long' for w in words)}, bands array<int>"
    signed = texts.mapInArrow(lambda it: _signatures(it, GRAM, BINS, ROWS, BANDS), schema)
    # Rows of one class have one signature, so copies end in the map-side part of this aggregation.
    single = C.cut(signed.groupBy("cls").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in (*words, "bands"))))
    digests = texts.mapInArrow(_digests, "id long, cls binary")
    members = C.cut(digests.join(single.select("cls", F.col("id").alias("rep")), "cls").select("id", "rep").distinct())
    differ = lambda p, q, w: F.col(f"{p}{w}").bitwiseXOR(F.col(f"{q}{w}"))
    far = lambda p, q: reduce(Column.__add__, (F.bit_count(differ(p, q, w)) for w in WORDS))
    # A band is kept as 32 bits; with its number it names the shard. That two bands meet by chance costs a comparison.
    bands = single.select(F.posexplode("bands").alias("band", "key"), "id")
    shards = bands.select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("key")).alias("shard"), "id")
    pairs = C.cut(range_pairs(shards, single.select("id", *words), radius, far, one_hamming, hamming_metric, _prints, cap, also=agree))
    # One of the two texts travels to the other; equal ids of repeated rows are one record.
    paired = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    once = C.likely_in(texts, paired, "id").dropDuplicates(["id"])
    links = (
        pairs.join(once.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(once.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        .mapInArrow(lambda it: _checked(it, share, run, LONG_RUN, LONG_SHARE), "a long, b long")
    )
    return NearDuplicates(C.cut(links), members)


# Names --------------------------------------------------------------------------------------------------------------

BRACKETED = re.compile(r"[(\[{<〈《「『【〔]([^)\]}>〉》」』】〕]*)[)\]}>〉》」』】〕]")
ISSUE, PLAN = re.compile(r"(?<![0-9])[0-9]{4}(?![0-9])"), re.compile(r"([0-9]+)\s*종(?![가-힣])")
# Fixed value: the word that stands for the document itself.
TERMS_WORD = "약관"


def _letters(text: str) -> str:
    return "".join(filter(str.isalnum, text)).casefold()


def calendar_day(text: str | None) -> str:
    """yyyymmdd of a date written in any of the usual ways, else empty."""
    groups = re.findall(r"[0-9]+", unicodedata.normalize("NFKC", text or ""))
    if groups and len(groups[0]) >= 8:
        return groups[0][:8]
    if len(groups) >= 3 and len(groups[0]) == 4 and max(len(groups[1]), len(groups[2])) <= 2:
        return groups[0] + groups[1].zfill(2) + groups[2].zfill(2)
    return ""


def marks_in(name: str) -> list[str]:
    """The marks that stand in brackets: what is between commas, letters only. Issue and plan numbers are no marks."""
    bare = PLAN.sub(" ", ISSUE.sub(" ", name))
    return [x for inner in BRACKETED.findall(bare) for part in re.split(r"[,/·、;]", inner) if (x := _letters(part))]


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = Counter(m for name in batch.column("name").to_pylist() for m in marks_in(unicodedata.normalize("NFKC", name or "")))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["mark", "n"])


def usual_marks(records: DataFrame, least: float = MARK_SHARE) -> list[str]:
    """Marks that make up at least `least` of all bracketed marks, so at most 1 / least of them; longest first."""
    counts = C.cut(records.select("name").where("name is not null").mapInArrow(_marks, "mark string, n long").groupBy("mark").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted((r.mark for r in counts.where(F.col("n") >= least * total).collect()), key=lambda m: (-len(m), m))


def _listing_keys(batches: Iterator[pa.RecordBatch], usual: list[str]) -> Iterator[pa.RecordBatch]:
    bare = re.compile("|".join(map(re.escape, [*usual, TERMS_WORD])))
    for batch in batches:
        out = []
        for i, name, date in zip(*(batch.column(c).to_pylist() for c in ("id", "name", "sale_date"))):
            day, text = calendar_day(date), unicodedata.normalize("NFKC", name or "")
            issue, plan = ISSUE.findall(text), PLAN.findall(text)
            core = bare.sub("", _letters(BRACKETED.sub(" ", PLAN.sub(" ", ISSUE.sub(" ", text)))))
            if core and day:
                out.append((i, day, ",".join(plan), ",".join(issue), core))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), *[pa.string()] * 4))], names=["id", "day", "plan", "issue", "core"])


def near_duplicate_names(records: DataFrame, edits: int = EDITS, cap: int = CAP) -> NearDuplicates:
    """records: id LONG, name STRING, sale_date STRING. Links rows of one day and plan whose names differ by at most `edits` letters.

    Names with two different issue numbers are never linked; a missing number goes with any.
    """
    usual = usual_marks(records)
    keys = C.cut(records.select("id", "name", "sale_date").mapInArrow(lambda it: _listing_keys(it, usual), "id long, day string, plan string, issue string, core string"))
    same = ["day", "plan", "issue", "core"]
    reps = keys.groupBy(same).agg(F.min("id").alias("rep"))
    members = C.cut(keys.join(reps, same).select("id", "rep").distinct())
    shards, points = reps.select(F.xxhash64("day", "plan").alias("shard"), F.col("rep").alias("id")), reps.select(F.col("rep").alias("id"), "core")
    pairs = range_pairs(shards, points, edits, lambda p, q: F.levenshtein(f"{p}core", f"{q}core"), one_edit, edit_metric, lambda c: c["core"], cap)
    a, b = (reps.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("day", "plan", "issue"))) for x in "ab")
    agree = (F.col("day_a") == F.col("day_b")) & (F.col("plan_a") == F.col("plan_b")) & ((F.col("issue_a") == F.col("issue_b")) | (F.col("issue_a") == "") | (F.col("issue_b") == ""))
    return NearDuplicates(C.cut(pairs.join(a, "a").join(b, "b").where(agree).select("a", "b")), members)
