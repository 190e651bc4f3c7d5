"""Project registry and stack inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Registry keys and common misspellings of them.
KNOWN_KEYS = ["name", "path", "url", "owned", "stack", "not"]
SUGGESTED_KEYS = {
    "urls": "url",
    "uri": "url",
    "host": "url",
    "dir": "path",
    "root": "path",
    "directory": "path",
    "owner": "owned",
}
PROJECT_SCHEMA = (
    "name string, path string, url string, owned string, stack struct<framework:string,db:string,auth:string>"
)


def registry_rows(spark: SparkSession, path: str) -> DataFrame:
    """One JSON string per registered project; fails on a file without a project list."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json(F.get_json_object("value", "$.projects"), "array<string>")
    return text.select(
        F.explode(
            F.when(entries.isNull(), F.raise_error(F.lit("the registry needs a 'projects' array"))).otherwise(entries)
        ).alias("entry")
    )


def parse_projects(rows: DataFrame, entry: str = "entry") -> DataFrame:
    parsed = rows.select(F.from_json(entry, PROJECT_SCHEMA).alias("p"), F.col(entry).alias("__e"))
    return parsed.select(
        F.col("p.name").alias("name"),
        F.col("p.path").alias("path"),
        F.col("p.url").alias("url"),
        # Owned only when the value is literally the JSON true, not a string.
        F.coalesce(F.col("__e").rlike('"owned"\\s*:\\s*true\\b'), F.lit(False)).alias("owned"),
        F.col("p.stack").alias("stack"),
    )


def unknown_keys(rows: DataFrame, entry: str = "entry") -> DataFrame:
    """Keys nobody reads: reported with a suggestion, never silently dropped."""
    keys = rows.select(
        F.get_json_object(entry, "$.name").alias("name"), F.explode(F.json_object_keys(entry)).alias("key")
    )
    suggestion = F.lit(None).cast("string")
    for wrong, right in SUGGESTED_KEYS.items():
        suggestion = F.when(F.col("key") == wrong, F.lit(right)).otherwise(suggestion)
    return keys.where(~F.col("key").isin(KNOWN_KEYS) & ~F.col("key").startswith("$")).select(
        "name", "key", suggestion.alias("suggested")
    )


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    rows = registry_rows(spark, path)
    return parse_projects(rows), unknown_keys(rows)


# Dependency names that decide the stack, first match wins.
FRAMEWORK_DEPS = [("next", ["next"]), ("vite", ["vite"])]
DB_DEPS = [
    ("supabase", ["@supabase/supabase-js", "@supabase/ssr"]),
    ("neon", ["@neondatabase/serverless"]),
    ("prisma", ["@prisma/client", "prisma"]),
    ("postgres", ["pg", "postgres"]),
]
AUTH_DEPS = [
    ("clerk", ["@clerk/nextjs", "@clerk/clerk-react", "@clerk/clerk-sdk-node"]),
    ("next-auth", ["next-auth", "@auth/core"]),
    ("supabase", ["@supabase/supabase-js"]),
]


def _by_dependency(deps: Column, table: list[tuple[str, list[str]]]) -> Column:
    expr = F.lit(None).cast("string")
    for value, names in reversed(table):
        expr = F.when(F.arrays_overlap(deps, F.array(*[F.lit(n) for n in names])), F.lit(value)).otherwise(expr)
    return expr


def infer_stack(files: DataFrame, projects: DataFrame | None = None) -> DataFrame:
    """framework, db and auth per project: given value, then dependencies, then config files."""
    parts = F.array_compact(
        F.array(
            F.json_object_keys(F.get_json_object("content", "$.dependencies")),
            F.json_object_keys(F.get_json_object("content", "$.devDependencies")),
        )
    )
    package = F.col("path") == "package.json"
    rows = files.where(
        F.col("path").isin(
            "package.json", "next.config.js", "next.config.mjs", "next.config.ts", "vite.config.js", "vite.config.ts"
        )
    )
    per = rows.groupBy("project").agg(
        F.coalesce(F.max(F.when(package, F.flatten(parts))), F.array().cast("array<string>")).alias("deps"),
        F.max(package).alias("has_package"),
        F.max(F.col("path").startswith("next.config.")).alias("next_config"),
        F.max(F.col("path").startswith("vite.config.")).alias("vite_config"),
    )
    inferred = files.select("project").distinct().join(per, "project", "left").select(
        "project",
        F.coalesce(
            _by_dependency(F.col("deps"), FRAMEWORK_DEPS),
            F.when(F.col("next_config"), F.lit("next")),
            F.when(F.col("vite_config"), F.lit("vite")),
            F.when(F.col("has_package"), F.lit("node")),
            F.lit("unknown"),
        ).alias("framework"),
        F.coalesce(_by_dependency(F.col("deps"), DB_DEPS), F.lit("unknown")).alias("db"),
        F.coalesce(_by_dependency(F.col("deps"), AUTH_DEPS), F.lit("unknown")).alias("auth"),
    )
    if projects is None:
        return inferred
    given = projects.select(
        F.col("name").alias("project"),
        *[F.col(f"stack.{c}").alias(f"__{c}") for c in ("framework", "db", "auth")],
    )
    return inferred.join(given, "project", "left").select(
        "project", *[F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) for c in ("framework", "db", "auth")]
    )
