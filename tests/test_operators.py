import random
import re

import duckdb
from pyspark.sql import functions as F

from plumbline.operators import clean, graph, joins, lines, ordered
from plumbline.workloads import operations


def files(spark, rows):
    return spark.createDataFrame(rows, "project string, path string, content string")


def test_lines_are_one_based_and_crlf_safe(spark):
    got = lines.explode_lines(files(spark, [("p", "a", "x\r\ny\n")])).orderBy("line_no").collect()
    assert [(r.line_no, r.text) for r in got] == [(1, "x"), (2, "y"), (3, "")]


def test_grep_columns_against_re(spark):
    rng = random.Random(5)
    rows = [("p", f"f{i}", "\n".join("".join(rng.choice("ab1 2é") for _ in range(rng.randint(0, 14))) for _ in range(5))) for i in range(40)]
    got = {(r.path, r.line_no, r.column_no, r.value) for r in lines.grep_lines(files(spark, rows), "[0-9]+").collect()}
    want = {
        (path, n + 1, m.start() + 1, m.group())
        for _, path, content in rows
        for n, line in enumerate(content.split("\n"))
        for m in re.finditer("[0-9]+", line)
    }
    assert got == want


def test_context_hits_against_a_loop(spark):
    rng = random.Random(9)
    rows = [(f"p{i % 3}", f"f{i}", "\n".join(rng.choice(["hit", "need", "stop", "x"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = {(r.path, r.line_no) for r in lines.context_hits(files(spark, rows), "hit", 2, 1, require="need", exclude="stop").collect()}
    want = set()
    for _, path, content in rows:
        ls = content.split("\n")
        for i, line in enumerate(ls):
            near = "\n".join(ls[max(0, i - 2) : i + 2])
            if "hit" in line and "need" in near and "stop" not in near:
                want.add((path, i + 1))
    assert got == want


def test_clean_keeps_positions(spark):
    rows = [
        ("p", "a.ts", 'const a = 1; // eval(\nconst r = /child_process/g; x = "this is a long sentence of plain words here";\nq(`select * from t where id = ${id}`); /* b\nlock */ y'),
        ("p", "b.ts", "const t = `a ${f({b:`x`})} and a lot of words`; z = a / b / c; new RegExp('eval\\\\(')"),
        ("p", "c.sql", "-- drop table x\nselect 1; /* open"),
        ("p", "d.py", "# eval( stays: python is not blanked"),
        ("p", "e.ts", ""),
        ("p", "f.ts", "'unterminated string\n`and template"),
    ]
    got = {r.path: r for r in clean.clean_corpus(files(spark, rows)).collect()}
    for r in got.values():
        assert len(r.clean) == len(r.content) and [i for i, c in enumerate(r.clean) if c == "\n"] == [i for i, c in enumerate(r.content) if c == "\n"]
    a = got["a.ts"].clean
    assert "eval" not in a and "child_process" not in a and "sentence" not in a and "select * from t" in a and a.endswith("y")
    assert "a / b / c" in got["b.ts"].clean and "eval" not in got["b.ts"].clean
    assert "drop" not in got["c.sql"].clean and "select 1" in got["c.sql"].clean
    assert got["d.py"].clean == got["d.py"].content


def test_clean_survives_large_inputs(spark):
    rows = [
        ("p", "a.ts", "/*" + " word" * 60_000 + "*/ x"),
        ("p", "b.ts", "'" + "a\\'" * 50_000 + "' x"),
        ("p", "c.ts", "`" + "${a}" * 20_000 + "` x"),
        ("p", "d.ts", "x = 1 + y;\n" * 30_000),
    ]
    for r in clean.clean_corpus(files(spark, rows)).collect():
        assert len(r.clean) == len(r.content)


def test_strip_and_mask(spark):
    df = spark.createDataFrame([("a /* b\nc */ d // e",), ("x = /eval\\(/; new RegExp('eval')",)], "v string")
    got = df.select(clean.strip_comments(F.col("v")).alias("s"), clean.mask_pattern_literals(F.col("v")).alias("m")).collect()
    assert got[0].s.count("\n") == 1 and "b" not in got[0].s and "e" not in got[0].s
    assert "eval" not in got[1].m and len(got[1].m) == len("x = /eval\\(/; new RegExp('eval')")


def test_strip_and_mask_query_on_odd_texts(spark, tmp_path):
    """Null and empty texts and empty first lines, against the query's SQL."""
    rng = random.Random(5)
    odd = [None, "", "\n", "\nsecond", " ", "\r\n", "/", "*/ x", "//", "\\", "[", "a\u2028b", "\u00a0", "\t\n", "n", "new RegExp('a')", "/" * 50]
    odd += ["".join(rng.choice("an/*\\[]'\"` \n\r\t\u0085\u2028\u00e9\U0001f600;=") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = operations.stripped(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(tuple(r) for r in got) == sorted(con.execute(operations.STRIPPED_SQL).fetchall())


def test_previous_value_across_blocks(spark):
    rng = random.Random(1)
    rows = sorted({(f"k{rng.randint(0, 3)}", rng.randint(0, 400)) for _ in range(200)})
    df = spark.createDataFrame(rows, "k string, t int")
    got = ordered.previous_value(df, ["k"], ["t"], "t", F.floor(F.col("t") / 37), "prev").collect()
    want, last = {}, {}
    for k, t in rows:
        want[(k, t)] = last.get(k)
        last[k] = t
    assert {(r.k, r.t): r.prev for r in got} == want


def test_carry_forward_across_blocks(spark):
    rng = random.Random(2)
    rows = [("d", i, rng.choice(["", "", "", "H%d" % i])) for i in range(300)] + [("e", i, "") for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v string")
    got = ordered.carry_forward(df, ["g"], "i", {"head": F.when(F.col("v") != "", F.col("v"))}, block_rows=17).collect()
    last, want = {}, {}
    for g, i, v in rows:
        if v:
            last[g] = v
        want[(g, i)] = last.get(g)
    assert {(r.g, r.i): r.head for r in got} == want


def test_spread_join_equals_plain_join(spark):
    big = spark.range(2000).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    small = spark.createDataFrame([(0, "a"), (2, "b")], "k long, n string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = {tuple(r) for r in big.join(small, "k", how).collect()}
        got = {tuple(r) for r in joins.spread_join(big, small, ["k"], how, spread_by=["v"]).collect()}
        assert got == want


def test_page_rank_sums_to_one_and_finds_orphans(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "src string, dst string")
    got = {r.url: r for r in graph.page_rank(nodes, edges, 12).collect()}
    assert abs(sum(r.pagerank for r in got.values()) - 1) < 1e-9
    assert got["d"].orphan and not got["b"].orphan and got["c"].in_links == 1


def test_redirect_chain_ends_and_stops_on_repeat(spark):
    hops = [("a", "b"), ("b", "a")] + [(f"n{i}", f"n{i + 1}") for i in range(12)]
    starts = spark.createDataFrame([("a",), ("n0",), ("z",)], "url string")
    got = {r.start: r for r in graph.redirect_chain(starts, spark.createDataFrame(hops, "url string, location string")).collect()}
    assert got["a"].hops == 2 and not got["a"].long
    assert got["n0"].hops == 12 and got["n0"].final == "n12" and got["n0"].long
    assert got["z"].hops == 0


def test_pages_of_two_hosts_stay_apart(spark):
    pages = [("https://a.example/x", '<a href="/y"><a href="https://a.example/z?q"><a href="//c.example/w"><a href="https://b.example/v">'), ("https://b.example/x", '<a href="/y">')]
    nodes, edges = graph.page_links(spark.createDataFrame(pages, "url string, html string"))
    assert {tuple(r) for r in edges.collect()} == {("a.example/x", "a.example/y"), ("a.example/x", "a.example/z"), ("b.example/x", "b.example/y")}
    assert nodes.count() == 5
