"""Newly arrived files scanned by the same detectors as the batch audit.

State is an upsert table keyed by file: the facts of the latest version of each file, in
buckets of projects. A batch reads and writes the buckets of its own projects only, so its
cost follows the batch and the buckets it touches and not all that was ever scanned:

* a bucket is copied on write: its new generation holds the old facts of files that did not
  come, and the facts of those that did;
* a row with ``deleted`` takes the file's facts out;
* findings are kept in the same way, audited again for the projects that the batch touched;
* a small table of generations is written last. Readers take the generation named there, so a
  batch that fails half way or runs twice changes nothing and leaves nothing behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators.joins import spread_join
from plumbline.plans import audit as A
from plumbline.plans import crossfile as X
from plumbline.plans import detect as D
from plumbline.session import cut_lineage, store_by

FILE_SCHEMA = "project string, path string, content string, tracked boolean, deleted boolean"
FACT_SCHEMA = "project string, path string, kind string, key string, line int, text string, level int"
FINDING_SCHEMA = "project string, rule_id string, file string, line int, snippet string, severity string, confidence string, note string"
GENERATION_SCHEMA = "bucket int"
#: Buckets of projects; also the most paths a reader opens.
BUCKETS = 64


def read_files(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(FILE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_facts(files: DataFrame) -> DataFrame:
    """The fused scan is stateless, so it runs on a stream unchanged."""
    return D.scan_facts(files, extractors=X.extractors())


def audit_facts(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Findings from stored facts."""
    flags = cut_lineage(D.project_flags(facts))
    helpers = D.helper_names(facts)
    calling = cut_lineage(D.files_calling(facts, helpers))
    ctx = A.Context(files if files is not None else facts, facts, flags, helpers, calling, None)
    found, _ = A.static_findings(ctx)
    return found


def bucket() -> F.Column:
    return F.pmod(F.xxhash64("project"), F.lit(BUCKETS)).cast("int")


def generations(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """Bucket -> the batch that wrote its current generation; at most BUCKETS entries."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/generations")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {}
    rows = spark.read.schema(GENERATION_SCHEMA + ", batch long").option("basePath", f"{path}/generations").parquet(f"{path}/generations")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return {r.bucket: r.batch for r in rows.groupBy("bucket").agg(F.max("batch").alias("batch")).collect()}


def _current(spark: SparkSession, path: str, table: str, named: dict[int, int], schema: str) -> DataFrame:
    """Rows of the named generations; each is a folder, so nothing else is opened."""
    if not named:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{table}/batch={g}/bucket={b}" for b, g in named.items()])


def _drop_superseded(spark: SparkSession, path: str, old: dict[int, int], older: dict[int, int]) -> None:
    """Generations that were replaced before the last batch: not even its repetition reads them."""
    for b, g in older.items():
        if old.get(b, g) != g:
            for table in ("facts", "findings"):
                place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{table}/batch={g}/bucket={b}")
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def upsert(batch: DataFrame, batch_id: int, path: str) -> None:
    """Take the files of a batch into the state under ``path`` and audit their projects again."""
    spark = batch.sparkSession
    base = batch.select("project", T.posix(F.col("path")).alias("path"), "content", "tracked", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    facts = cut_lineage(D.scan_facts(base.where("not deleted").drop("deleted"), extractors=X.extractors()))
    came = base.select("project", "path").distinct()
    projects = cut_lineage(came.select("project").distinct().withColumn("bucket", bucket()))
    touched = [r.bucket for r in projects.select("bucket").distinct().collect()]  # at most BUCKETS
    if not touched:
        return
    named = {b: g for b, g in generations(spark, path, batch_id).items() if b in touched}
    old = _current(spark, path, "facts", named, FACT_SCHEMA)
    stay = spread_join(old, came, ["project", "path"], "left_anti", spread_by=["kind", "key"])
    state = cut_lineage(stay.unionByName(facts.select(*stay.columns)))
    again = spread_join(state, projects.select("project"), ["project"], "left_semi", spread_by=["path", "key"])
    # Stored by kind: some sixty branches read it, each its own kinds.
    found = audit_facts(store_by(again, "kind")).select(*[c.split()[0] for c in FINDING_SCHEMA.split(", ")])
    others = _current(spark, path, "findings", named, FINDING_SCHEMA).join(projects.select("project"), "project", "left_anti")
    for table, rows in (("facts", state), ("findings", others.unionByName(found))):
        # A bucket whose last file is gone keeps an empty generation.
        out = f"{path}/{table}/batch={batch_id}"
        # Dealt by bucket, or each task would open a file in each; Spark splits a large bucket again.
        rows.withColumn("bucket", bucket()).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        empty = spark.createDataFrame([], FACT_SCHEMA if table == "facts" else FINDING_SCHEMA)
        fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
        for b in touched:
            if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/bucket={b}")):
                empty.write.mode("overwrite").parquet(f"{out}/bucket={b}")
    spark.createDataFrame([(b,) for b in touched], GENERATION_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/generations/batch={batch_id}")
    _drop_superseded(spark, path, generations(spark, path, batch_id), generations(spark, path, batch_id - 1))


def incremental_audit(files: DataFrame, path: str, checkpoint: str):
    """Run :func:`upsert` on each batch of a stream of files. Of a file that arrives twice in
    one batch one row must be given; across batches the later version counts."""
    return (
        files.writeStream.foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings of all projects as of the last batch."""
    return _current(spark, path, "findings", generations(spark, path), FINDING_SCHEMA)


def current_facts(spark: SparkSession, path: str) -> DataFrame:
    return _current(spark, path, "facts", generations(spark, path), FACT_SCHEMA)
