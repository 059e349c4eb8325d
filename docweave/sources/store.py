"""Parquet store of versioned graphs and document artifacts.

Writes append: rows carry the number of their write, and a marker row per stem and version says which write is the
present one. Replacing a graph, emptying or deleting it is one small append that takes effect at once, no other graph's
files are touched, and a marker without rows is "extracted but empty", unlike no marker at all. Rows are sorted by scope
within the files instead of one folder a document, so the number of files does not grow with the number of documents.
One writer per scope is assumed.

Manifests, schema versions, active versions and question sets are appended in the same way: the last row of a key holds,
a deletion is a row of its own. Nothing is overwritten in place. compact() writes each table into a new folder, which
readers take once it is complete; a compaction that fails leaves the old folder in use.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import graph as G
from ..shared import checkpointed, is_missing

SCOPE = ["stem", "version"]
NODE_SCHEMA = (
    "id string, original_id string, label string, type string, detail string, properties map<string,string>, confidence string, evidence_text string, start_offset long, end_offset long, "
    "source_section string, valid_from string, valid_to string, embedding array<float>, stem string, version long"
)
EDGE_SCHEMA = "source string, target string, type string, detail string, confidence string, stem string, version long"
MARKER_SCHEMA = "stem string, version long, nodes_write long, edges_write long, deleted boolean, marked long"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*\z"


class NotFound(LookupError):
    pass


class GraphStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # Tables -----------------------------------------------------------------------------------------------------------

    def _path(self, name: str) -> str:
        """The folder in use: the newest complete generation, else the first one."""
        return f"{self.root}/{name}/{max(self._generations(name), default='0')}"

    def _generations(self, name: str) -> list[str]:
        """Folders of a table that a compaction completed, in order."""
        folders = self._listed(f"{self.root}/{name}")
        return sorted(x for x in folders if x != "0" and self._exists(f"{self.root}/{name}/{x}/_SUCCESS"))

    def read(self, name: str, schema: str | StructType) -> DataFrame:
        """The table, or an empty one with the schema where nothing was ever written; older files lack newer columns."""
        try:
            return self.spark.read.schema(schema).parquet(self._path(name))
        except AnalysisException as e:
            if not is_missing(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._hadoop(path)
        return fs.exists(p)

    def _listed(self, path: str) -> list[str]:
        fs, p = self._hadoop(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def _remove(self, path: str) -> None:
        fs, p = self._hadoop(path)
        fs.delete(p, True)

    def tables(self) -> list[str]:
        return self._listed(self.root)

    def _add(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path(name))

    def _fit(self, df: DataFrame, schema: str) -> DataFrame:
        """Columns of the schema in its order, missing ones null."""
        wanted = self.spark.createDataFrame([], schema).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    # Graphs -----------------------------------------------------------------------------------------------------------

    def _heads(self) -> DataFrame:
        """Per scope the last marker: which write its nodes and edges come from, and whether it was deleted."""
        m = self.read("extracted", MARKER_SCHEMA)
        return m.groupBy(*SCOPE).agg(F.max_by(F.struct("nodes_write", "edges_write", "deleted"), "marked").alias("h")).select(*SCOPE, "h.*")

    def extracted(self) -> DataFrame:
        """The scopes that have a graph, empty ones included."""
        return self._heads().where("not deleted").select(*SCOPE)

    def _current(self, name: str, schema: str) -> DataFrame:
        heads = self._heads().where("not deleted").select(*SCOPE, F.col(f"{name}_write").alias("write_id"))
        return self.read(name, f"{schema}, write_id long").join(heads, [*SCOPE, "write_id"], "left_semi").drop("write_id")

    def nodes(self) -> DataFrame:
        return self._current("nodes", NODE_SCHEMA)

    def edges(self) -> DataFrame:
        return self._current("edges", EDGE_SCHEMA)

    def _append(self, name: str, rows: DataFrame, write: int) -> None:
        """Rows sorted by scope, so that a read of one scope skips the files and row groups without it; a stem with very many rows is split."""
        rows.withColumn("write_id", F.lit(write).cast("long")).hint("rebalance", "stem").sortWithinPartitions(*SCOPE).write.mode("append").parquet(self._path(name))

    def _mark(self, heads: DataFrame) -> None:
        """The commit: readers see a write once its markers are there."""
        self._add("extracted", heads.withColumn("marked", F.lit(time.time_ns())).select(*SCOPE, "nodes_write", "edges_write", "deleted", "marked"))

    def write_graphs(self, nodes: DataFrame, edges: DataFrame, scopes: DataFrame | None = None) -> None:
        """Replace the graphs of all given scopes. Invalid type names and dangling edges raise before anything is written.

        scopes names the stems and versions to replace, those of the nodes where it is not given; a scope without nodes
        becomes an empty graph.
        """
        n, e = self._fit(nodes, NODE_SCHEMA), self._fit(edges, EDGE_SCHEMA)
        odd = n.select("type").union(e.select("type")).where(~F.coalesce(F.col("type").rlike(IDENTIFIER), F.lit(False))).limit(1).collect()
        if odd:
            raise ValueError(f"{odd[0].type!r} is no valid type name")
        loose = G.dangling_edges(n, e).limit(1).collect()
        if loose:
            raise ValueError(f"edge {loose[0].source} -> {loose[0].target} has an end that is no node")
        write = time.time_ns()
        self._append("nodes", n, write)
        self._append("edges", e, write)
        scopes = (n if scopes is None else scopes).select("stem", F.col("version").cast("long").alias("version")).distinct()
        self._mark(scopes.select(*SCOPE, F.lit(write).alias("nodes_write"), F.lit(write).alias("edges_write"), F.lit(False).alias("deleted")))

    def load_graph(self, stem: str, version: int = 1) -> tuple[DataFrame, DataFrame] | None:
        """Nodes by id and edges by type, source and target; None where the scope was never extracted."""
        if not self.has_graph(stem, version):
            return None
        n = G.read_nodes(G.scoped(self.nodes(), stem, version)).orderBy("id")
        return n, G.scoped(self.edges(), stem, version).orderBy("type", "source", "target")

    def has_graph(self, stem: str, version: int = 1) -> bool:
        return not G.scoped(self.extracted(), stem, version).isEmpty()

    def _delete(self, scopes: DataFrame) -> None:
        none = F.lit(None).cast("long")
        self._mark(scopes.select(*SCOPE, none.alias("nodes_write"), none.alias("edges_write"), F.lit(True).alias("deleted")))

    def delete_version(self, stem: str, version: int) -> None:
        self.delete_graphs(self.spark.createDataFrame([(stem, version)], "stem string, version long"))

    def delete_graphs(self, scopes: DataFrame) -> None:
        """Delete the graphs of the given stems and versions; scopes without a graph are left out."""
        self._delete(self.extracted().join(scopes.select(*SCOPE).distinct(), SCOPE, "left_semi"))

    def delete_documents(self, stems: DataFrame) -> None:
        """Delete all graphs, manifests and schema versions of the given stems."""
        stems = stems.select("stem").distinct()
        self._delete(self.extracted().join(stems, "stem", "left_semi"))
        self._put("manifests", self.manifests().join(stems, "stem", "left_semi"), deleted=True)
        self._put("versions", self.schema_versions().drop("is_active").join(stems, "stem", "left_semi"), deleted=True)

    def delete_document(self, stem: str) -> None:
        self.delete_documents(self.spark.createDataFrame([(stem,)], "stem string"))

    def update_embeddings(self, vectors: DataFrame) -> None:
        """New vectors (stem, version, id, embedding) replace old ones by id; running it again changes nothing."""
        scopes = vectors.select(*SCOPE).distinct()
        touched = self.nodes().join(scopes, SCOPE, "left_semi")
        new = vectors.select(*SCOPE, "id", F.col("embedding").alias("new"))
        joined = touched.join(new, [*SCOPE, "id"], "left").withColumn("embedding", F.coalesce("new", "embedding"))
        write = time.time_ns()
        self._append("nodes", self._fit(joined, NODE_SCHEMA), write)
        self._mark(self._heads().where("not deleted").join(scopes, SCOPE, "left_semi").withColumn("nodes_write", F.lit(write)))

    def compact(self) -> None:
        """Drop replaced and deleted rows from the files. No writer may be at work; readers are not disturbed."""
        heads = checkpointed(self._heads())
        for name, schema, live in (("nodes", NODE_SCHEMA, self.nodes()), ("edges", EDGE_SCHEMA, self.edges())):
            kept = live.join(heads.select(*SCOPE, F.col(f"{name}_write").alias("write_id")), SCOPE)
            self._renew(name, self._fit(kept, f"{schema}, write_id long").sortWithinPartitions(*SCOPE))
        self._renew("extracted", heads.where("not deleted").withColumn("marked", F.lit(0).cast("long")).select(*SCOPE, "nodes_write", "edges_write", "deleted", "marked"))
        for name, (_, schema) in LOGS.items():
            if name in self.tables():
                self._renew(name, self._latest(name).withColumns({"written": F.lit(0).cast("long"), "deleted": F.lit(False)}).select(*self._logged(schema).names))

    def _renew(self, name: str, rows: DataFrame) -> None:
        """Rows as the table's next generation. It counts once it is complete; older ones but the last are then removed."""
        before = self._generations(name)
        rows.write.parquet(f"{self.root}/{name}/{time.time_ns():020d}")
        for old in (["0"] if before else []) + before[:-1]:
            self._remove(f"{self.root}/{name}/{old}")

    def reset(self) -> None:
        for name in self.tables():
            self._remove(f"{self.root}/{name}")

    # Artifacts --------------------------------------------------------------------------------------------------------

    def _logged(self, schema: str) -> StructType:
        return self.spark.createDataFrame([], f"{schema}, deleted boolean, written long").schema

    def _put(self, name: str, rows: DataFrame, deleted: bool = False) -> None:
        """Append rows that hold from now on. They may be read from the same table, so they are cut loose from it first."""
        schema = LOGS[name][1]
        self._add(name, checkpointed(self._fit(rows, schema).withColumns({"deleted": F.lit(deleted), "written": F.lit(time.time_ns())})))

    def _latest(self, name: str) -> DataFrame:
        """Per key the row written last, without the deleted ones."""
        keys, schema = LOGS[name]
        rows = self.read(name, self._logged(schema))
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "written").alias("r")).select(*keys, "r.*").where("not deleted").drop("deleted", "written")

    def manifests(self) -> DataFrame:
        return self._latest("manifests")

    def save_manifests(self, given: DataFrame) -> None:
        """Create or update manifests by stem. Columns that are missing or null leave what was there."""
        fields = [c for c in ("original_filename", "converter") if c in given.columns]
        old = self.manifests().select("stem", *(F.col(c).alias(f"old_{c}") for c in ("original_filename", "converter")))
        new = given.select("stem", *fields).join(old, "stem", "left")
        self._put("manifests", new.select("stem", *((F.coalesce(c, f"old_{c}") if c in fields else F.col(f"old_{c}")).alias(c) for c in ("original_filename", "converter"))))

    def save_manifest(self, stem: str, **given: str | None) -> None:
        """Create or update: only the given fields change."""
        self.save_manifests(self.spark.createDataFrame([(stem, given.get("original_filename"), given.get("converter"))], MANIFEST_SCHEMA))

    def schema_versions(self) -> DataFrame:
        """stem, version, document_type, digest, is_active. The highest version is active where the named one is gone."""
        v = self._latest("versions")
        named = self._latest("active").select("stem", F.col("version").alias("named"))
        goal = v.join(named, "stem", "left").groupBy("stem").agg(F.coalesce(F.max(F.when(F.col("version") == F.col("named"), F.col("version"))), F.max("version")).alias("goal"))
        return v.join(goal, "stem").select(*v.columns, (F.col("version") == F.col("goal")).alias("is_active"))

    def create_schema_versions(self, schemas: DataFrame) -> DataFrame:
        """schemas: stem, document_type, digest, one row a stem. The next version of each becomes its active one; stem, version of these."""
        last = self._latest("versions").groupBy("stem").agg(F.max("version").alias("last"))
        new = checkpointed(schemas.select("stem", "document_type", "digest").join(last, "stem", "left").withColumn("version", F.coalesce("last", F.lit(0)) + 1))
        self._put("versions", new)
        self._put("active", new)
        return new.select(*SCOPE)

    def create_schema_version(self, stem: str, document_type: str, digest: str) -> int:
        """The next version number; the new version becomes the active one."""
        return self.create_schema_versions(self.spark.createDataFrame([(stem, document_type, digest)], "stem string, document_type string, digest string")).first().version

    def activate_versions(self, scopes: DataFrame) -> None:
        unknown = scopes.select(*SCOPE).join(self._latest("versions"), SCOPE, "left_anti").limit(1).collect()
        if unknown:
            raise NotFound(f"{unknown[0].stem} has no schema version {unknown[0].version}")
        self._put("active", scopes)

    def activate_version(self, stem: str, version: int) -> None:
        self.activate_versions(self.spark.createDataFrame([(stem, version)], "stem string, version long"))

    def delete_schema_versions(self, scopes: DataFrame) -> None:
        """Schema versions with their graphs. The highest version left becomes active where the active one goes."""
        scopes = checkpointed(scopes.select(*SCOPE).distinct())
        self._put("versions", scopes, deleted=True)
        self.delete_graphs(scopes)

    def delete_schema_version(self, stem: str, version: int) -> None:
        self.delete_schema_versions(self.spark.createDataFrame([(stem, version)], "stem string, version long"))

    def active_version(self, stem: str) -> int:
        row = self.schema_versions().where((F.col("stem") == stem) & F.col("is_active")).first()
        if row is None:
            raise NotFound(f"{stem} has no active schema")
        return row.version

    def goldensets(self, schema: str | StructType) -> DataFrame:
        """The present question sets of all documents, in the given columns."""
        rows = self.read("goldenset", self.spark.createDataFrame([], schema).schema.add("write_id", "long"))
        return rows.join(self._latest("goldenset_heads"), ["stem", "write_id"], "left_semi").drop("write_id")

    def save_goldensets(self, questions: DataFrame) -> DataFrame:
        """Replace the question sets of the stems in `questions`. A set that differs from the one before is archived; stems of these."""
        stems = questions.select("stem").distinct()
        old = self.goldensets(questions.schema).join(stems, "stem", "left_semi").select(questions.columns)
        key = lambda rows, n: rows.groupBy(F.to_json(F.struct(*questions.columns)).alias("row"), "stem").agg(F.count("*").alias(n))
        both = key(old, "was").join(key(questions, "now"), ["row", "stem"], "full_outer").fillna(0, ["was", "now"])
        sets = both.groupBy("stem").agg(F.sum("was").alias("was"), F.bool_or(F.col("was") != F.col("now")).alias("differs"))
        differs = checkpointed(sets.where("was > 0 and differs").select("stem"))
        self._add("goldenset_archive", checkpointed(old.join(differs, "stem", "left_semi").withColumn("archived_at", F.current_timestamp())))
        write = time.time_ns()
        self._add("goldenset", questions.withColumn("write_id", F.lit(write)))
        self._put("goldenset_heads", stems.withColumn("write_id", F.lit(write)))
        return differs

    def save_goldenset(self, questions: DataFrame, stem: str) -> bool:
        """Replace a document's questions; the old set is archived only where it differs. True if it was archived."""
        return not self.save_goldensets(questions.where(F.col("stem") == stem)).isEmpty()

    def append_answers(self, answers: DataFrame) -> None:
        self._add("answers", answers)

    # Layout of tables -------------------------------------------------------------------------------------------------

    def table_columns(self) -> dict[str, list[str]]:
        """The columns of every table that was written."""
        return {n: self.spark.read.parquet(self._path(n)).columns for n in self.tables()}


MANIFEST_SCHEMA = "stem string, original_filename string, converter string"
#: Tables of which the last row of a key holds: keys and columns.
LOGS = {
    "manifests": (["stem"], MANIFEST_SCHEMA),
    "versions": (SCOPE, "stem string, version long, document_type string, digest string"),
    "active": (["stem"], "stem string, version long"),
    "goldenset_heads": (["stem"], "stem string, write_id long"),
}


def with_envelope(old: DataFrame, schema: str = NODE_SCHEMA) -> DataFrame:
    """Rows of an older layout under the present schema: missing columns are null, a missing original id is the last part of the id."""
    wanted = old.sparkSession.createDataFrame([], schema)
    full = old.unionByName(wanted, allowMissingColumns=True)
    return full.withColumn("original_id", F.coalesce("original_id", F.element_at(F.split("id", "::"), -1))).select(wanted.columns)
