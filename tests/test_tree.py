"""Files on disk, those whose names start with a dot included."""

from plumbline.sources import corpus


def test_scan_finds_dot_files(spark, tmp_path):
    made = {
        "one/.env": "KEY=1", "one/.gitignore": "node_modules", "one/src/a.ts": "export const a = 1;", "one/.git/config": "x",
        "one/node_modules/.env": "KEY=2", "one/sub/.bash_history": "ls", "one/.hidden.ts": "export const b = 2;",
        "two/.env.local": "é", "two/empty/.gitkeep": "", "two/.env.big": "x" * 5000, "two/pic.png": "no",
    }
    for path, text in made.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    got = {(r.project, r.path): r.content for r in corpus.scan_corpus(spark, str(tmp_path)).collect()}
    want = ["one/.env", "one/.gitignore", "one/src/a.ts", "one/sub/.bash_history", "one/.hidden.ts", "two/.env.local", "two/.env.big"]
    assert got == {tuple(p.split("/", 1)): made[p] for p in want}
    small = {(r.project, r.path) for r in corpus.scan_corpus(spark, "file://" + str(tmp_path), size_limit=100).collect()}
    assert small == {tuple(p.split("/", 1)) for p in want if p != "two/.env.big"}


def test_given_hidden_files_win(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/.env").write_text("ON=disk")
    (tmp_path / "p/a.py").write_text("x = 1")
    given = spark.createDataFrame([("p", ".env", "FROM=table", 10)], "project string, path string, content string, size long")
    got = {r.path: r.content for r in corpus.scan_corpus(spark, str(tmp_path), hidden=given).collect()}
    assert got == {".env": "FROM=table", "a.py": "x = 1"}
