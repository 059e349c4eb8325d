"""Problem 2: the best representative of each duplicate group.

Method: dependent fields form *bundles*, taken whole from one row. A functional dependency between two bundles says
that the value of the first fixes the value of the second (the most trusted one stated beside it). The assignment of
one candidate value to each bundle with the highest total trust that keeps all dependencies is found by branch and
bound, in Arrow batches, for every group. A candidate enters the search unless another one dominates it: of values
that imply the same and are implied alike only the most trusted can be in a best assignment, and where the best values
of all bundles keep the dependencies among them nothing else can be. So a group brings to its search what its
dependencies leave open, never its rows; dominated candidates are left out by aggregations.

A group with one row is no duplicate group. A bundle none of whose rows is usable has no survivor. Trust is the rank
of the confidence, then the time, then the length of the value, then the smaller row number; nulls rank last. Ranks
add up over the bundles; of assignments with equal sums the one wins whose first bundle has the more trusted value, then
whose second has, and so on, so the order of the rows never matters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

# What stands for a missing value, compared without case, space and separators.
STAND_INS = ("", "-", "--", "na", "n/a", "nan", "null", "nil", "none", "tbd", "tba", "unknown", "undefined", "없음", "해당없음", "미상", "미정", "알수없음", "?", ".")
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000\u00a0"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + "  "
CANDIDATE = "array<struct<bundle:int,rank:int,when:timestamp_ntz,length:int,no:bigint,value:string>>"
IMPLIED = "array<struct<rule:int,x:string,y:string>>"


def usable(value: Column) -> Column:
    key = F.regexp_replace(F.lower(F.translate(value, WIDE, NARROW)), r"(?U)[\s_]", "")
    return value.isNotNull() & ~key.isin(*STAND_INS)


def folded(value: Column) -> Column:
    """Letters and digits of a value in lower case and normal width."""
    return F.regexp_replace(F.lower(F.translate(value, WIDE, NARROW)), r"[^\p{L}\p{N}\p{M}]", "")


@dataclass(frozen=True)
class Bundle:
    name: str
    fields: tuple[str, ...]

    def usable(self) -> Column:
        return usable(F.col(self.fields[0]).cast("string"))

    def value(self) -> Column:
        return F.to_json(F.struct(*self.fields)) if len(self.fields) > 1 else F.col(self.fields[0]).cast("string")

    def trust(self) -> Column:
        """The larger struct is the better value; the last field is the negative row number."""
        parts = F.struct(F.col("rank_"), F.col("when_"), F.length(F.col(self.fields[0]).cast("string")).alias("length"), (-F.col("no_")).alias("no"))
        return F.when(self.usable(), parts)


def best_assignment(options: list[list[tuple]], rules: list[tuple[int, int]], implied: dict[tuple[int, str], str]) -> list[tuple]:
    """options: for each bundle (rank, when, length, no, value), in any order; the candidate chosen for each bundle, None where it has none.

    implied: the value of the second bundle that a rule and a value of its first bundle allow; without entry any.
    """
    scored = []
    for own in options:
        # Later, longer and smaller-numbered first; null times last.
        ranked = sorted(own, key=lambda c: (c[0], c[1] is not None, c[1] or 0, c[2] or 0, -c[3]), reverse=True)
        scored.append([(c[0] + 1, c) for c in ranked] or [(0, None)])
    rest = [0]
    for own in reversed(scored):
        rest.append(rest[-1] + own[0][0])
    rest.reverse()
    best: list = [-1, []]
    chosen: list = []

    def keeps(k: int) -> bool:
        for r, (x, y) in enumerate(rules):
            if k == max(x, y) and chosen[x] is not None:
                allowed = implied.get((r, chosen[x][4]))
                if allowed is not None and chosen[y] is not None and chosen[y][4] != allowed:
                    return False
        return True

    def search(k: int, score: int) -> None:
        if k == len(scored):
            best[:] = [score, list(chosen)]
            return
        for gain, c in scored[k]:
            if score + gain + rest[k + 1] <= best[0]:
                break  # bound: no candidate after this one can do better, and of equals the first found is the more trusted
            chosen.append(c)
            if keeps(k):
                search(k + 1, score + gain)
            chosen.pop()

    search(0, 0)
    return best[1]


def _branch(batches: Iterator[pa.RecordBatch], names: list[str], rules: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = batch.column("group_no").to_pylist()
        listed, implied = batch.column("candidates"), batch.column("implied")
        c, cut_at = listed.flatten(), listed.offsets.to_pylist()
        i, implied_at = implied.flatten(), implied.offsets.to_pylist()
        parts = [c.field(f) for f in ("rank", "when", "length", "no", "value")]
        bundle, values = c.field("bundle").to_pylist(), list(zip(*(x.cast(pa.int64()).to_pylist() if pa.types.is_timestamp(x.type) else x.to_pylist() for x in parts)))
        stated = list(zip(*(i.field(f).to_pylist() for f in ("rule", "x", "y"))))
        first, first_implied = cut_at[0], implied_at[0]
        out = []
        for k, group in enumerate(groups):
            options: list[list[tuple]] = [[] for _ in names]
            for j in range(cut_at[k] - first, cut_at[k + 1] - first):
                options[bundle[j]].append(values[j])
            known = {(r, x): y for r, x, y in stated[implied_at[k] - first_implied : implied_at[k + 1] - first_implied]}
            out += [(group, n, x[3]) for n, x in zip(names, best_assignment(options, rules, known)) if x is not None]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64()))], names=["group_no", "bundle", "from_no"])


def best_bundles(rows: DataFrame, group: list[str], number: str, confidence: str, time: str, bundles: list[Bundle], rules: list[tuple[str, str]] = ()) -> DataFrame:
    """group_no, bundle, from_no: the row each bundle's surviving value comes from. The group columns must not be null.

    rules: pairs of bundle names, the first of which determines the second.
    """
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("HIGH", 3, "MEDIUM", 2, "LOW", 1))), F.upper(F.trim(F.col(confidence)))), F.lit(0))
    base = rows.withColumn("no_", F.col(number)).withColumn("rank_", rank).withColumn("when_", F.col(time).cast("timestamp_ntz"))
    base = base.select(*dict.fromkeys([*group, "no_", "rank_", "when_", *(f for b in bundles for f in b.fields)]))
    if rules:
        base = C.cut(base)  # read twice
    names = [b.name for b in bundles]
    index = [(names.index(x), names.index(y)) for x, y in rules]
    root = base.groupBy(*group).agg(F.min("no_").alias("group_no"), F.count("*").alias("n_"), *(F.max(b.trust()).alias(f"best_{b.name}") for b in bundles)).where("n_ > 1")

    def entry(k: int, trust: Column, value: Column) -> Column:
        return F.struct(F.lit(k).alias("bundle"), trust["rank_"].alias("rank"), trust["when_"].alias("when"), trust["length"].alias("length"), (-trust["no"]).alias("no"), value.alias("value"))

    # The best value of every bundle dominates all others of a group in which these values keep the rules.
    top = lambda which: F.filter(F.array(*(F.when(F.col(f"best_{names[k]}").isNotNull(), entry(k, F.col(f"best_{names[k]}"), F.lit(None).cast("string"))) for k in which)), lambda x: x.isNotNull()).cast(CANDIDATE)
    free = lambda df: df.select("group_no", top(range(len(names))).alias("candidates"), F.array().cast(IMPLIED).alias("implied"))
    searched = lambda df: df.mapInArrow(lambda it: _branch(it, names, index), "group_no long, bundle string, from_no long")
    if not rules:
        return searched(free(root))
    root = C.cut(root)
    # Only bundles that a rule names can be anything but their best; the others need no candidates.
    ruled = sorted({k for rule in index for k in rule})
    loose = [k for k in range(len(bundles)) if k not in ruled]
    # The value each left side implies: the most trusted right side stated beside it in the group.
    keys = root.select(*group, "group_no", *(F.col(f"best_{names[k]}") for k in ruled))
    needed = dict.fromkeys(["no_", "rank_", "when_", *(f for k in ruled for f in bundles[k].fields)])
    tied = C.cut(base.join(keys, group).select(*needed, "group_no", *(f"best_{names[k]}" for k in ruled)))
    stated = None
    for r, (x, y) in enumerate(index):
        bx, by = bundles[x], bundles[y]
        pairs = tied.where(bx.usable() & by.usable()).groupBy("group_no", F.lit(r).alias("rule"), bx.value().alias("x")).agg(F.max_by(by.value(), by.trust()).alias("y"))
        stated = pairs if stated is None else stated.union(pairs)
    stated = C.cut(stated)
    candidates = None
    for k in ruled:
        b = bundles[k]
        own = tied.where(b.usable()).groupBy("group_no", F.lit(k).alias("bundle"), b.value().alias("value")).agg(F.max(b.trust()).alias("trust"), F.first(f"best_{b.name}").alias("top"))
        own = own.select("group_no", "bundle", "value", "trust", (F.col("trust") == F.col("top")).alias("is_top"))
        candidates = own if candidates is None else candidates.union(own)
    candidates = C.cut(candidates)
    best = candidates.where("is_top").groupBy("group_no").agg(F.map_from_entries(F.collect_list(F.struct("bundle", "value"))).alias("tops"))
    side = lambda k: F.element_at("tops", F.element_at(F.array(*(F.lit(i[k]) for i in index)), F.col("rule") + 1))
    broken = C.cut(stated.join(best, "group_no").where((side(0) == F.col("x")) & side(1).isNotNull() & (side(1) != F.col("y"))).select("group_no").distinct())
    kept = None
    for k in ruled:
        own = candidates.where(F.col("bundle") == k).join(broken, "group_no", "left_semi")
        alike = []
        for r, (x, y) in enumerate(index):
            if x == k:
                implies = stated.where(F.col("rule") == r).select("group_no", F.col("x").alias("value"), F.col("y").alias(f"implies_{r}"))
                own, alike = own.join(implies, ["group_no", "value"], "left"), [*alike, f"implies_{r}"]
        if any(y == k for _, y in index):
            own, alike = own.withColumn("itself", F.col("value")), [*alike, "itself"]
        most = own.groupBy("group_no", "bundle", *alike).agg(F.max_by(F.struct("value", "trust"), "trust").alias("c")).select("group_no", "bundle", "c.*")
        kept = most if kept is None else kept.union(most)
    kept = C.cut(kept)
    used = kept.select("group_no", F.col("value").alias("x")).distinct()
    implied = stated.join(used, ["group_no", "x"], "left_semi").groupBy("group_no").agg(F.collect_list(F.struct("rule", "x", "y")).cast(IMPLIED).alias("implied"))
    entries = F.struct("bundle", F.col("trust.rank_").alias("rank"), F.col("trust.when_").alias("when"), F.col("trust.length").alias("length"), (-F.col("trust.no")).alias("no"), "value")
    listed = kept.groupBy("group_no").agg(F.collect_list(entries).cast(CANDIDATE).alias("ruled"))
    rest = root.join(broken, "group_no", "left_semi").select("group_no", (top(loose) if loose else F.array().cast(CANDIDATE)).alias("loose"))
    open_groups = listed.join(rest, "group_no").select("group_no", F.concat("ruled", "loose").alias("candidates")).join(implied, "group_no")
    return searched(free(root.join(broken, "group_no", "left_anti")).unionByName(open_groups))


def with_thing_keys(nodes: DataFrame) -> DataFrame:
    """nodes with label_id, a digest of stem, version and folded label, and type_key, the folded type.

    A row without usable type takes the type key of its label's rows. Rows without usable label are left out. Null stems
    and versions are values of their own.
    """
    folded_label = folded(F.col("label"))
    scope = F.concat_ws("\u0001", F.coalesce("stem", F.lit("\u0002")), F.coalesce(F.col("version").cast("string"), F.lit("\u0002")), folded_label)
    keyed = nodes.where(usable(F.col("label")) & (folded_label != "")).withColumn("label_id", F.unhex(F.md5(scope)))
    keyed = keyed.withColumn("type_key", F.when(usable(F.col("type")), folded(F.col("type"))))
    typed, untyped = keyed.where("type_key is not null"), keyed.where("type_key is null").drop("type_key")
    # Only labels that have a row without usable type need their types looked up.
    known = typed.select("label_id", "type_key").join(untyped.select("label_id").distinct(), "label_id", "left_semi").groupBy("label_id").agg(F.min("type_key").alias("type_key"))
    found = untyped.join(known, "label_id", "left").withColumn("type_key", F.coalesce("type_key", F.lit("")))
    return typed.unionByName(found)


GROUP = ["label_id", "type_key"]
FIELDS = [Bundle("label", ("label",)), Bundle("type", ("type",)), Bundle("detail", ("detail",))]
EVIDENCE = [*FIELDS, Bundle("evidence", ("evidence_text", "start_offset", "end_offset", "chunk_id")), Bundle("section", ("source_section",))]


def surviving_fields(nodes: DataFrame) -> DataFrame:
    """group_no, field_name, from_no for label, type and detail, each a bundle of its own."""
    return best_bundles(with_thing_keys(nodes), GROUP, "node_no", "confidence", "extracted_at", FIELDS).withColumnRenamed("bundle", "field_name")


def surviving_records(nodes: DataFrame) -> DataFrame:
    """One record a group: label, type and detail by themselves, the evidence with its offsets and chunk as a bundle, the section as that evidence states it."""
    keyed = with_thing_keys(nodes)
    chosen = best_bundles(keyed, GROUP, "node_no", "confidence", "extracted_at", EVIDENCE, [("evidence", "section")])
    by_row = chosen.groupBy("group_no", "from_no").agg(F.collect_set("bundle").alias("bundles"))
    values = by_row.join(nodes.select(F.col("node_no").alias("from_no"), *(c for b in EVIDENCE for c in b.fields)), "from_no")
    take = lambda b, c: F.max(F.when(F.array_contains("bundles", b), F.col(c))).alias(c)
    return values.groupBy("group_no").agg(*(take(b.name, c) for b in EVIDENCE for c in b.fields))
