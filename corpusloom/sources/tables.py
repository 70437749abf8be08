"""Typed tables, and the other sources and sinks of an edition."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of an edition.
_TABLES = {
    "repo_hits": "repo string, path string, component string, query_id string, blob_sha string, is_fork boolean",
    "s1_overflows": "seed string, query string, total bigint, reachable bigint",
    "repos": "repo string, missing boolean, error string, stars bigint, is_fork boolean, is_template boolean, created_at string, pushed_at string, language string, license string, head_oid string, tree_truncated bigint, canary boolean",
    "harness_files": "repo string, path string, kind string, blob_sha string, size bigint, fetched boolean, skip_reason string",
    "redactions": "blob_sha string, rule string, n bigint",
    "blobs": "oid string, version bigint, counts string, text string",
    "artifacts": "artifact_id string, repo string, kind string, path string, blob_sha string, parsed_json string, error_class string",
    "clusters": "cluster_id string, kind string, canonical_artifact string, size bigint",
    "membership": "artifact_id string, cluster_id string, tier string, family_key string",
    "lineage": "cluster_id string, origin_repo string, origin_basis string, upstream_lib string",
    "mutations": "artifact_id string, cluster_id string, mutation_class string",
    "features": "repo string, technique_id string, artifact_id string, path string, start_line bigint, end_line bigint",
    "glyphs": "repo string, claude_md_log_bytes double, n_skills bigint, n_agents bigint, n_commands bigint, n_hooks bigint, permission_breadth double, n_mcp_servers bigint",
    "semantics": "cluster_id string, pass_id string, artifact_id string, use_case string, domain_guess string, non_coding boolean, techniques_json string, notable string",
    "semantics_rejects": "cluster_id string, pass_id string, reason string",
    "llm_calls": "call_id string, pass_id string, model string, n_sent bigint, n_ok bigint, error string, wall_s double, cost_usd double",
    "use_cases": "use_case_id string, parent_id string, level bigint, label string, non_coding boolean, size bigint",
    "uc_membership": "cluster_id string, use_case_id string",
    "technique_candidates": "candidate_id string, label string, size bigint, nearest_technique string, similarity double, is_candidate boolean, examples_json string",
    "uncharted": "cluster_id string, use_case string, nn_distance double, rank bigint",
}


def schema(table: str) -> str:
    """DDL of a table; a KeyError names a table that isn't declared."""
    return _TABLES[table]


#: Bytes of a row group of blobs.
BLOB_GROUP = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors must share. Where it is unset, a new folder if driver and executors are one
    process (tests), else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settled(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that its lineage ends there. Its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(cleanup) if was is None else spark.conf.set(cleanup, was)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and put there by one rename that replaces what was there: readers see the old text or
    the new one, whenever this stops."""
    fs, target = file_system(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    _replace(spark, part, target)


def _replace(spark: SparkSession, part, target) -> None:
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = gateway.new_array(kind, 1)
    how[0] = kind.OVERWRITE
    fs = part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(part), fs.makeQualified(target), how)


def get_text(spark: SparkSession, path: str) -> str | None:
    fs, target = file_system(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


#: Sums of 60-bit pieces of rows' hashes.
PIECES = 4


def sums(rows: DataFrame) -> list[int]:
    """The number of rows and the sums of pieces of their hashes: they don't depend on the order, and those of parts add up."""
    row = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    pieces = rows.select(F.sha2(row, 256).alias("h")).select(*[F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)").alias(f"h{k}") for k in range(PIECES)])
    told = pieces.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"h{k}").alias(f"s{k}") for k in range(PIECES)]).first()
    return [int(x or 0) for x in told]


def digest(added: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, added)).encode()).hexdigest()


class Store:
    """Tables of an edition under one folder. A part's rows lie in a folder of their own, and a small file that is replaced by one rename
    names it, with the sums of its rows. What no such file names isn't part of the table, so a part is there whole, old or new."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, table: str, *below: str) -> str:
        schema(table)
        return "/".join([f"{self.root}/tables/{table}", *below])

    def _named(self, table: str) -> dict[str, dict]:
        """What the small files of a table's parts say; a part that another one replaces is gone."""
        fs, path = file_system(self.spark, self._at(table, "parts"))
        names = {s.getPath().getName() for s in fs.listStatus(path)} if fs.exists(path) else set()
        found = {n: json.loads(get_text(self.spark, self._at(table, "parts", n))) for n in sorted(names) if not n.startswith(".")}
        gone = {p for named in found.values() for p in named.get("replaces", ())}
        return {n: named for n, named in found.items() if n not in gone}

    def read(self, table: str) -> DataFrame:
        """All parts; an empty frame with the schema where there are none."""
        folders = [self._at(table, "rows", named["rows"]) for named in self._named(table).values()]
        return self.spark.read.schema(schema(table)).parquet(*folders) if folders else self.spark.createDataFrame([], schema(table))

    def parts(self, table: str) -> set[str]:
        return set(self._named(table))

    def digest(self, table: str) -> str:
        """A hash of all rows, from the sums that were kept when the parts were written; no row is read."""
        each = [named["sums"] for named in self._named(table).values()]
        return digest([sum(x) for x in zip(*each, strict=True)] or [0] * (1 + PIECES))

    def write_part(self, table: str, part: str, rows: DataFrame, replaces: set[str] = frozenset()) -> int:
        """Columns that are missing become null, wrong types and unknown columns are errors; returns the row count. The part takes the place of
        those it replaces at once. Blobs lie in the order of their ids, with filters for them in the files."""
        wanted = self.spark.createDataFrame([], schema(table)).schema
        if unknown := set(rows.columns) - set(wanted.names):
            raise ValueError(f"{table} has no columns {sorted(unknown)}")
        shaped = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])
        options = {"compression": "zstd"}
        if table == "blobs":
            shaped = shaped.repartitionByRange("oid").sortWithinPartitions("oid")
            options |= {"parquet.bloom.filter.enabled#oid": "true", "parquet.block.size": str(BLOB_GROUP)}
        name = f"{part}-{uuid.uuid4().hex}"
        shaped.write.options(**options).parquet(self._at(table, "rows", name))
        added = sums(self.spark.read.schema(wanted).parquet(self._at(table, "rows", name)))
        was = self._named(table)
        self._commit(table, part, {"rows": name, "sums": added, "replaces": sorted(replaces - {part})})
        for old in ({part} | replaces) & was.keys():
            self._drop(table, was[old]["rows"])
        for old in replaces - {part}:
            self._unlink(table, old)
        return added[0]

    def _unlink(self, table: str, part: str) -> None:
        fs, path = file_system(self.spark, self._at(table, "parts", part))
        fs.delete(path, False)

    def _commit(self, table: str, part: str, named: dict) -> None:
        put_text(self.spark, self._at(table, "parts", part), json.dumps(named))

    def _drop(self, table: str, name: str) -> None:
        fs, path = file_system(self.spark, self._at(table, "rows", name))
        fs.delete(path, True)

    def read_part(self, table: str, part: str) -> DataFrame:
        return self.spark.read.schema(schema(table)).parquet(self._at(table, "rows", self._named(table)[part]["rows"]))

    def delete_part(self, table: str, part: str) -> None:
        if named := self._named(table).get(part):
            self._unlink(table, part)
            self._drop(table, named["rows"])

    def clear(self, table: str) -> None:
        for below in ("parts", "rows"):
            fs, path = file_system(self.spark, self._at(table, below))
            fs.delete(path, True)

    def blobs(self, ids: list[str]) -> DataFrame:
        """The blobs of some ids. Only row groups whose range and filter may hold one are read."""
        asked = [F.col("oid").isin(ids[k : k + 10]) for k in range(0, len(ids), 10)]  # lists this long are tested by the files' filters
        return self.read("blobs").filter(reduce(Column.__or__, asked, F.lit(False)))

    def views(self) -> SparkSession:
        """A session of its own that holds only views named v_..., without repos that are missing or canaries and what hangs on
        them. The tables themselves are no views in it, and files can't be queried by path."""
        own = self.spark.newSession()
        mine = Store(own, self.root)
        hidden = F.coalesce("missing", F.lit(False)) | F.coalesce("canary", F.lit(False))
        repos = mine.read("repos").filter(~hidden)
        only = lambda rows, by, column: rows.join(by.select(column), column, "left_semi")
        artifacts = only(mine.read("artifacts"), repos, "repo")
        membership = only(mine.read("membership"), artifacts, "artifact_id")
        clusters = only(mine.read("clusters"), membership, "cluster_id")
        cases = mine.read("use_cases")
        leaf = mine.read("uc_membership").join(membership, "cluster_id").join(artifacts, "artifact_id").select("use_case_id", "repo").distinct()
        above = leaf.join(cases.filter("parent_id is not null"), "use_case_id").select(F.col("parent_id").alias("use_case_id"), "repo")
        found = {
            "v_repos": repos, "v_artifacts": artifacts, "v_membership": membership, "v_clusters": clusters, "v_features": only(mine.read("features"), repos, "repo"),
            "v_glyphs": only(mine.read("glyphs"), repos, "repo"), "v_semantics": only(mine.read("semantics").filter("pass_id = 'a'"), clusters, "cluster_id"),
            "v_use_cases": cases, "v_uc_leaf_repos": leaf, "v_uc_repos": leaf.unionByName(above).distinct(),
        }
        for name, rows in found.items():
            rows.createOrReplaceTempView(name)
        own.conf.set("spark.sql.runSQLOnFiles", "false")
        return own


def read_jsonl(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """Objects of a JSON-lines file, which may be split among tasks. The last line may be cut short (no line break after it, or
    no object) and is then left out; damage before it is an error that names the line's number among those of its task."""
    fs, target = file_system(spark, path)
    size = fs.getFileStatus(target).getLen()
    stream = fs.open(target)
    stream.seek(max(0, size - 1))
    ended = size > 0 and stream.read() == ord("\n")
    stream.close()
    lines = spark.read.option("lineSep", "\n").text(path).select(F.monotonically_increasing_id().alias("n"), "value")  # ids follow the file
    lines = settled(lines, "lines").filter("trim(value) != ''")
    last = lines.agg(F.max("n")).first()[0]
    good = F.col("value").rlike(r"^\s*\{") & F.expr("try_parse_json(value) IS NOT NULL")
    rows = lines.select("n", "value", good.alias("good")).filter((F.col("n") != F.lit(last)) | (F.col("good") & F.lit(ended)))
    task, place = F.shiftright("n", 33), F.col("n").bitwiseAND(F.lit((1 << 33) - 1))
    message = F.concat(F.lit(f"{path}: corrupt line "), (place + 1).cast("string"), F.lit(" of part "), (task + 1).cast("string"))
    safe = rows.select(F.when(F.col("good"), F.from_json("value", columns)).otherwise(F.raise_error(message)).alias("r"))
    return safe.select("r.*")


def legacy_blobs(spark: SparkSession, root: str) -> DataFrame:
    """oid, version, counts, text of a folder with one compressed file for each blob: a line of JSON, then the text."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, _, text = zstandard.ZstdDecompressor().decompressobj().decompress(content).decode().partition("\n")
                told = json.loads(head)
                rows.append({"oid": path.rsplit("/", 1)[1].split(".")[0], "version": told.get("redact_version", 0), "counts": json.dumps(told.get("counts", {}), sort_keys=True), "text": text})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("oid", pa.string()), ("version", pa.int64()), ("counts", pa.string()), ("text", pa.string())]))

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    return raw.mapInArrow(run, schema("blobs"))


def fixture_files(spark: SparkSession, root: str) -> DataFrame:
    """repo, path, blob_sha (as git has it), data of the files below <root>/<owner>__<name>/; dot.x stands for .x and a
    trailing .fixture is dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.regexp_extract("path", r"/([^/]+__[^/]+)/(.+)$", 2)
    named = F.regexp_replace(F.regexp_replace(below, r"(^|/)dot\.", "$1."), r"\.fixture$", "")
    blob = F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.length("content").cast("string")), "UTF-8"), F.unhex(F.lit("00")), F.col("content")))
    repo = F.replace(F.regexp_extract("path", r"/([^/]+__[^/]+)/(.+)$", 1), F.lit("__"), F.lit("/"))
    return raw.select(repo.alias("repo"), named.alias("path"), blob.alias("blob_sha"), F.col("content").alias("data")).filter("path != '_repo.json'")
