from lodestrata.sources import bundle, code, diagnostics, documents, files, git, web


def test_markdown():
    title, rows = documents.markdown_sections("---\na: 1\n---\nintro\n# One\ntext\n```\n# not\n```\n## Two\nmore\n# Three\n")
    assert title == "One" and [(d, h) for d, h, _ in rows] == [(0, []), (1, ["One"]), (2, ["One", "Two"]), (1, ["Three"])] and "# not" in rows[1][2]


def test_html(spark):
    page = "<html><head><title>T</title><script>x()</script></head><body><nav>skip</nav><main><h1>Head</h1><p>Some <b>bold</b> <a href='u'>link</a>.</p><ul><li>one<ol><li>in</li></ol></li><li>two</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre>x = 1\ny</pre></main><footer>f</footer></body></html>"
    title, md = documents.html_to_markdown(page)
    assert title == "T" and "# Head" in md and "Some **bold** [link](u)." in md and "| a | b |" in md and "```\nx = 1\ny\n```" in md and "skip" not in md and "- one" in md
    assert documents.main_content(page).startswith("<main>")
    assert "long enough" in documents.main_content("<body><div><a>x</a></div><div><p>" + "long enough text " * 5 + "</p></div></body>")
    df = spark.createDataFrame([("p", page), ("n", None)], "path string, content string")
    assert [r.id for r in documents.read_html(df).collect()] == ["p#head"]


def test_paged(spark):
    df = spark.createDataFrame([("a/b.pdf", 1, "Title line\nrest"), ("a/b.pdf", 2, "  "), ("a/b.pdf", 3, "x")], "path string, page int, text string")
    assert [(r.title, r.heading_path, r.position) for r in documents.read_paged(df).orderBy("position").collect()] == [("Title line", ["Page 1"], 0), ("Title line", ["Page 3"], 2)]


def test_diff_and_blame(spark):
    diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n@@ -9 +10 @@\n@@ -5,3 +0,0 @@\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n"
    got = [(r.path, r.lo, r.hi) for r in git.changed_ranges(spark.createDataFrame([("d", diff)], "source string, text string")).collect()]
    assert sorted(got) == [("x", 1, 1), ("x", 3, 6), ("x", 10, 10)]
    a, b = "a" * 40, "b" * 40
    text = f"{a} 1 1 2\nauthor Ann\nauthor-time 5\n\tline\n{a} 2 2\n\tline\n{b} 3 3 1\nauthor Bob\nauthor-time 9\n\tline\n"
    df = spark.createDataFrame([("s", text)], "source string, text string")
    assert [(r.author, r.lines) for r in git.blame(df).collect()] == [("Ann", 2), ("Bob", 1)]
    assert [(r.author, r.time, r.lines) for r in git.last_author(df).collect()] == [("Bob", 9, 3)]


def test_web(spark):
    xml = '<?xml version="1.0"?><urlset><url><loc>https://a.b/docs/x</loc><lastmod>2024</lastmod></url><!-- <url><loc>no</loc></url> --><url><loc>https://a.b/z?a=1&amp;b</loc></url></urlset>'
    e = web.sitemap_entries(spark.createDataFrame([("s", xml)], "source string, xml string"))
    assert [(r.url, r.lastmod) for r in e.orderBy("position").collect()] == [("https://a.b/docs/x", "2024"), ("https://a.b/z?a=1&b", None)]
    assert web.select_pages(e, "/docs").count() == 1
    text = "\n# Name\n> About it.\n\n## Docs\n- [One](https://a/1): first\n* [Two](b)\n## Optional\n- [Three](c)\n"
    got = [(r.title, r.description, r.section, r.optional, r.name, r.url, r.note) for r in web.link_lists(spark.createDataFrame([("l", text)], "source string, text string")).orderBy("position").collect()]
    assert got == [("Name", "About it.", "Docs", False, "One", "https://a/1", "first"), ("Name", "About it.", "Docs", False, "Two", "b", None), ("Name", "About it.", "Optional", True, "Three", "c", None)]
    old = spark.createDataFrame([("u", "e1", "l", "h"), ("v", "e", "l", "h"), ("w", "e", "l", "h")], "url string, etag string, last_modified string, content_hash string")
    new = spark.createDataFrame([("u", "e1", "l", "h"), ("v", "f", "m", "g"), ("x", "e", "l", "h")], "url string, etag string, last_modified string, content_hash string")
    assert {r.url: r.action for r in web.refresh_plan(old, new).collect()} == {"u": "keep", "v": "update", "w": "drop", "x": "add"}


def test_diagnostics(spark):
    rows = [
        ("1", "cargo", '{"reason":"compiler-message","message":{"level":"error","message":"m","code":{"code":"E1"},"spans":[{"file_name":"a.rs","line_start":3,"column_start":4,"is_primary":true}]}}\n{"reason":"build-finished"}'),
        ("2", "eslint", '[{"filePath":"a.js","messages":[{"ruleId":"r","severity":2,"message":"m","line":1,"column":2}]}]'), ("3", "ruff", '[{"filename":"a.py","code":"F1","message":"m","location":{"row":5,"column":6}}]'),
        ("4", "tsc", "a.ts(7,8): error TS1: m\nnoise"), ("5", "gcc", "a.c:9:10: warning: m [-Wall]\n"), ("6", "sarif", '{"runs":[{"tool":{"driver":{"name":"t"}},"results":[{"ruleId":"r","message":{"text":"m"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"a.x"},"region":{"startLine":11,"startColumn":12}}}]}]}]}'),
        ("7", "gcc", None), ("8", "eslint", "broken"),
    ]
    got = {(r.source, r.path, r.line, r.col, r.severity, r.code) for r in diagnostics.all_tools(spark.createDataFrame(rows, "source string, tool string, text string")).collect()}
    assert got == {("1", "a.rs", 3, 4, "error", "E1"), ("2", "a.js", 1, 2, "error", "r"), ("3", "a.py", 5, 6, "warning", "F1"), ("4", "a.ts", 7, 8, "error", "TS1"), ("5", "a.c", 9, 10, "warning", "-Wall"), ("6", "a.x", 11, 12, "warning", "r")}


def test_code():
    py = "import os\nclass A(B):\n    def f(self, x):\n        if x and y:\n            return g(x)\n\nK = 1\n"
    assert [(s[0], s[1], s[2], s[4], s[5], s[6]) for s in code.symbols("a.py", py)] == [("A", "class", "", 2, 5, 3), ("f", "method", "A", 3, 5, 3), ("K", "constant", "", 7, 7, 1)]
    assert set(code.references("a.py", py)) == {("os", 1, "imports"), ("B", 2, "implements"), ("g", 5, "calls")}
    rs = "impl T for S {\n    pub fn f(&self) -> i64 {\n        if a > 1 { return g(2); }\n        1\n    }\n}\n\npub fn h() {}\n"
    assert [(s[0], s[1], s[2]) for s in code.symbols("a.rs", rs)] == [("S", "impl", ""), ("f", "method", "S"), ("h", "function", "")]
    assert ("T", 1, "implements") in code.references("a.rs", rs) and ("g", 3, "calls") in code.references("a.rs", rs)
    assert code.occurrences("a.js", "let é = x;")[1:] == [("é", 1, 4, 4, 6), ("x", 1, 8, 9, 10)]
    assert code.endpoints("a.py", "@app.get('/Items/')\ndef x(): pass\n") == [("http_route", "export", "GET /items", 1)]
    assert code.endpoints("a.ts", "fetch('/items', { method: 'POST' })") == [("http_route", "import", "POST /items", 1)]
    assert code.symbols("a.py", "def broken(:\n    pass\n")[0][0] == "broken" and code.symbols("a.md", "x") == []


def test_files_and_bundle(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "node_modules").mkdir()
    for name in ("src/a.py", "src/b.md", "src/c.min.js", "node_modules/d.js", "src/Dockerfile"):
        (tmp_path / name).write_text("x")
    got = {r.path.rsplit("/", 1)[1]: r.kind for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.py": "code", "b.md": "markdown", "Dockerfile": "code"}
    roots = spark.createDataFrame([("r", "h")], "root_id string, root_hash string")
    bundle.write_bundle({"t": roots, "sessions": roots}, roots, str(tmp_path / "b"))
    version, tables = bundle.read_bundle(spark, str(tmp_path / "b"))
    assert version == bundle.version_hash(roots) and list(tables) == ["t"] and tables["t"].count() == 1


def test_sections_of_files_without_symbols_are_whole(spark):
    long = "{\n" + "\n".join(f'  "key{k}": [{k}, "some words of a value"],' for k in range(200)) + "\n}\n"
    script = "\n".join(f"print({k})" for k in range(40))
    df = spark.createDataFrame([("a/x.json", long), ("y.py", script)], "path string, content string")
    got = {}
    for r in code.read_sections(df).orderBy("path", "position").collect():
        got.setdefault(r.path, []).append(r)
    assert "\n".join(r.text for r in got["a/x.json"]) == long and "\n".join(r.text for r in got["y.py"]) == script
    assert len(got["a/x.json"]) > 1 and all(len(r.text.split()) <= 256 and r.line_end - r.line_start == r.text.count("\n") for r in got["a/x.json"])
