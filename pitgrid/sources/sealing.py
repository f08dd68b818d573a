"""Evidence sealed by content: SHA-256 of every file, a hash tree over them, a status that only moves forward, and reviews
bound to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A seal is first PENDING and then, once, either of the others.
LADDER = ("PENDING", "SEALED", "REJECTED")
#: Hex digits of the names' hashes by which files are put together, level by level: 256 children a node.
_LEVELS = (6, 4, 2, 0)
_ENTRY = "name string, path string, n_bytes long, sha256 string"


def _root(spark: SparkSession, root: str) -> str:
    """The folder as Spark names its files."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def evidence(spark: SparkSession, root: str, name: Column | None = None) -> DataFrame:
    """(name, path, n_bytes, sha256) of all files under root. The path is relative to root; name, an expression over the
    column `path`, tells what an entry is called (its path, if not given). A file is one row: 2 GB at most. Spark passes over
    files without bytes and names that begin with a dot or an underscore; they hold no evidence here."""
    base = _root(spark, root)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = found.select(F.expr(f"substring(path, {len(base) + 2})").alias("path"), F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))
    return relative.select((F.col("path") if name is None else name).alias("name"), "path", "n_bytes", "sha256")


def tree_root(entries: DataFrame) -> str:
    """Root of the hash tree over (name, n_bytes, sha256): leaves are placed by the hash of their name, 256 to a node, so
    that no task holds more than the children of one node. Without entries, the hash of nothing."""
    leaf = F.sha2(F.concat_ws("\n", "name", F.col("n_bytes").cast("string"), "sha256"), 256)
    level = entries.select(F.sha2("name", 256).alias("place"), leaf.alias("hash"))
    for digits in _LEVELS:
        up = F.substring("place", 1, digits) if digits else F.lit("")
        children = F.array_sort(F.collect_list(F.struct("place", "hash")))
        level = level.groupBy(up.alias("up")).agg(F.sha2(F.array_join(F.transform(children, lambda c: c.hash), "\n"), 256).alias("hash")).select(F.col("up").alias("place"), "hash")
    found = level.first()
    return found["hash"] if found else "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def escapes(path: Column) -> Column:
    """Whether a manifest's path leaves the root: it is absolute, names a drive or scheme, or climbs."""
    return path.isNull() | (path == "") | path.startswith("/") | path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | path.rlike(r"(^|[/\\])\.\.([/\\]|$)")


def open_seal(spark: SparkSession, root: str, seal: str, name: Column | None = None) -> DataFrame:
    """Write the manifest of the files under root to the new folder seal, status PENDING. Returns the entries."""
    evidence(spark, root, name).write.mode("errorifexists").parquet(f"{seal}/entries")
    entries = spark.read.schema(_ENTRY).parquet(f"{seal}/entries")
    _record(spark, seal, "PENDING", tree_root(entries))
    return entries


def _record(spark: SparkSession, seal: str, status: str, root_hash: str) -> None:
    row = spark.createDataFrame([(LADDER.index(status), status, root_hash)], "step int, status string, root_hash string")
    row.coalesce(1).write.mode("errorifexists").parquet(f"{seal}/status/{status}")


def seal_status(spark: SparkSession, seal: str) -> tuple[str, str]:
    """(status, root hash)."""
    steps = spark.read.option("recursiveFileLookup", True).schema("step int, status string, root_hash string").parquet(f"{seal}/status")
    last = steps.orderBy(F.desc("step")).first()
    return last.status, last.root_hash


def problems(spark: SparkSession, root: str, entries: DataFrame, name: Column | None = None) -> DataFrame:
    """(name, problem): entries and files that don't agree: OUTSIDE_ROOT, MISSING, NOT_IN_MANIFEST, SIZE_DIFFERS,
    HASH_DIFFERS, NAMED_TWICE."""
    now, then = evidence(spark, root, name).alias("a"), entries.alias("b")
    twice = entries.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit("NAMED_TWICE").alias("problem"))
    both = now.join(then, F.col("a.name") == F.col("b.name"), "full")
    problem = (
        F.when(F.col("b.name").isNotNull() & escapes(F.col("b.path")), "OUTSIDE_ROOT").when(F.col("a.name").isNull(), "MISSING").when(F.col("b.name").isNull(), "NOT_IN_MANIFEST")
        .when(F.col("a.n_bytes") != F.col("b.n_bytes"), "SIZE_DIFFERS").when(F.col("a.sha256") != F.col("b.sha256"), "HASH_DIFFERS")
    )
    return both.select(F.coalesce("a.name", "b.name").alias("name"), problem.alias("problem")).where("problem is not null").union(twice).distinct()


def close_seal(spark: SparkSession, root: str, seal: str, name: Column | None = None) -> str:
    """Check a pending seal against the files and move it to SEALED or REJECTED; a seal that has left PENDING stays."""
    status, root_hash = seal_status(spark, seal)
    if status != "PENDING":
        raise ValueError(f"{seal} is {status} already")
    entries = spark.read.schema(_ENTRY).parquet(f"{seal}/entries")
    good = not problems(spark, root, entries, name).take(1) and tree_root(entries) == root_hash
    _record(spark, seal, "SEALED" if good else "REJECTED", root_hash)
    return "SEALED" if good else "REJECTED"


def require_sealed(spark: SparkSession, root: str, seal: str, name: Column | None = None) -> str:
    """The root hash of evidence that is sealed and still as it was; else an error."""
    status, root_hash = seal_status(spark, seal)
    if status != "SEALED":
        raise ValueError(f"{seal} is {status}, not SEALED")
    entries = spark.read.schema(_ENTRY).parquet(f"{seal}/entries")
    if bad := problems(spark, root, entries, name).take(1):
        raise ValueError(f"{root} is not as sealed: {bad[0].name} {bad[0].problem}")
    if tree_root(entries) != root_hash:
        raise ValueError(f"{seal}: the manifest was changed")
    return root_hash


def bound_reviews(reviews: DataFrame, root_hash: str) -> DataFrame:
    """reviews (with a column root_hash) and whether each is of just this evidence."""
    return reviews.withColumn("binding", F.when(F.col("root_hash").isNull(), "UNBOUND").when(F.col("root_hash") == root_hash, "BOUND").otherwise("OTHER_EVIDENCE"))
