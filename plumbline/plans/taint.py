"""Where the caller's data goes: a fixpoint over assignments, calls and imports.

A node is a name in a function of a file. Data moves along edges: from the names in a value to
the name it is assigned to, and from an argument to the parameter of a function of that name
in the same file or in an imported module. It enters where a value reads the request, or calls
a function that does; a value that is made safe passes nothing on. Rounds go on until none
adds a node and look at the newest nodes only; all joins are on names within a project.

Flows are followed in files that read request data or use file sinks, which is where the scan
emits its facts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import spread_join
from plumbline.plans import patterns as P
from plumbline.plans import scoped
from plumbline.session import cut_lineage

NODE = ["project", "path", "func", "name"]


def _kind(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("kind") == kind)


def _keyed(rows: DataFrame) -> DataFrame:
    """``chain`` (functions from the file down to the innermost) and ``what`` from the key."""
    return rows.withColumn("chain", F.split(F.substring_index("key", "|", 1), ",")).withColumn("what", F.expr("substring(key, instr(key, '|') + 1)"))


def _names(text: Column) -> Column:
    """Names in a value; those behind a dot are members, and strings are no names."""
    bare = F.regexp_replace(F.regexp_replace(text, "\"[^\"]*\"|'[^']*'", " "), r"\.\s*[A-Za-z_$][\w$]*", " ")
    return F.array_distinct(F.regexp_extract_all(bare, F.lit(rf"({scoped.NAME})"), F.lit(1)))


def flow_edges(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges from one node to another, nodes where data enters)."""
    flow = _keyed(_kind(facts, "flow")).where("level < 2").withColumn("func", F.element_at("chain", -1))
    used = flow.withColumn("name", F.explode(_names(F.col("text")))).withColumn("from", F.explode("chain"))
    inside = used.select(
        "project", "path", F.col("from").alias("func"), "name", F.col("path").alias("to_path"), F.col("func").alias("to_func"), F.col("what").alias("to_name")
    )
    reading = _kind(facts, "reads_caller").select("project", F.col("key").alias("callee")).distinct()
    calling = flow.withColumn("callee", F.explode(F.regexp_extract_all("text", F.lit(rf"({scoped.NAME})\s*\("), F.lit(1))))
    entered = flow.where("level = 1").select("project", "path", "func", F.col("what").alias("name"))
    through = spread_join(calling, reading, ["project", "callee"], "left_semi", spread_by=["path", "line"]).select("project", "path", "func", F.col("what").alias("name"))

    module = F.regexp_replace(F.substring_index("path", "/", -1), "[.][^.]+$", "")
    parameters = _kind(facts, "param").select(
        "project", F.col("key").alias("callee"), F.col("path").alias("to_path"), F.col("level").cast("string").alias("to_func"), module.alias("module"),
        F.posexplode(F.split("text", ",")).alias("at", "parameter"),
    )
    parameters = parameters.withColumn("to_name", F.regexp_extract("parameter", rf"^\s*({scoped.NAME})", 1)).where("to_name <> ''").drop("parameter")
    passed = _keyed(_kind(facts, "pass")).select("project", "path", "chain", F.col("what").alias("callee"), F.posexplode(F.split("text", ",")).alias("at", "argument"))
    imported = _kind(facts, "import").select("project", F.col("path"), F.col("key").alias("module"), F.lit(True).alias("linked")).distinct()
    met = spread_join(passed, parameters, ["project", "callee", "at"], "inner", spread_by=["path", "argument"])
    met = met.join(imported, ["project", "path", "module"], "left").where((F.col("path") == F.col("to_path")) | F.col("linked"))
    plain = F.regexp_extract("argument", rf"^\s*({scoped.NAME})\s*$", 1)
    across = met.withColumn("name", plain).where("name <> ''").withColumn("func", F.explode("chain")).select(*NODE, "to_path", "to_func", "to_name")
    handed = met.where(F.col("argument").rlike(P.C.FROM_CALLER) & ~F.col("argument").rlike(P.C.MADE_SAFE)).select(
        "project", F.col("to_path").alias("path"), F.col("to_func").alias("func"), F.col("to_name").alias("name")
    )
    edges = inside.unionByName(across).where("not (path = to_path and func = to_func and name = to_name)").distinct()
    return cut_lineage(edges), cut_lineage(entered.unionByName(through).unionByName(handed).distinct())


def tainted(facts: DataFrame) -> DataFrame:
    """(project, path, func, name): names that hold the caller's data."""
    edges, fresh = flow_edges(facts)
    known = fresh
    while not fresh.isEmpty():
        moved = spread_join(edges, fresh, NODE, "left_semi", spread_by=["to_path", "to_func", "to_name"])
        reached = moved.select("project", F.col("to_path").alias("path"), F.col("to_func").alias("func"), F.col("to_name").alias("name")).distinct()
        fresh = cut_lineage(reached.join(known, NODE, "left_anti"))
        known = known.unionByName(fresh)
    return known


def tainted_sinks(facts: DataFrame) -> DataFrame:
    """(project, path, line, text): file sinks whose argument reads or holds the caller's data."""
    sinks = _keyed(_kind(facts, "sink")).select("project", "path", "line", "text", "chain", "what")
    direct = sinks.where(F.col("what").rlike(P.C.FROM_CALLER)).select("project", "path", "line", "text")
    used = sinks.withColumn("name", F.explode(_names(F.col("what")))).withColumn("func", F.explode("chain"))
    held = used.join(tainted(facts), NODE, "left_semi").select("project", "path", "line", "text")
    return direct.unionByName(held).distinct()
