from lodestrata.llm import provenance as P

CODE = "import math\n\n\ndef alpha_one(a, b):\n    return math.sqrt(a) + b\n\n\ndef beta_two(c):\n    for k in range(c):\n        print(k, c * 3)\n    return c\n\n\nclass Gamma:\n    size = 4\n\n    def run(self, x):\n        return [y for y in x if y > self.size]\n"


def test_composition():
    assert P.composition(CODE, "py") is None
    assert P.composition("// Code generated by x. DO NOT EDIT.\n\npackage a\n", "go") == "generated"
    assert P.composition(CODE + "\n# Machine written (x). Edit the template instead.\n", "py") == "generated"
    assert P.composition("# Erzeugt von x - nicht bearbeiten\n" + CODE, "py") == "generated"
    assert P.composition("# Helpers that write generated bindings. Edit freely, this one is hand-made.\n# The emitted header says DO NOT EDIT; keep that string in one place.\n" + CODE, "py") is None
    assert P.composition(CODE.replace("math.sqrt(a)", "'@generated'"), "py") is None
    assert P.composition("\x7fELF\x00\x01\x02" * 40, "c") == "blob"
    assert P.composition("DATA = [\n" + "    1, 22, 333, 4444,\n" * 60 + "]\n", "py") == "blob"
    assert P.composition("P = [\n" + ('    "' + "QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9w" + '",\n') * 30 + "]\n", "py") == "blob"
    assert P.composition("package a\n\nvar Data = []int{" + ", ".join(f"0x{k * 7919 % 65536:04x}" for k in range(300)) + ",}\n", "go") == "blob"
    assert P.composition("package a\n\nvar Table = []int{" + ", ".join(f"0x{k * 7919 % 65536:04x}" for k in range(40)) + "}\n\nfunc F(x int) int {\n\treturn Table[x]\n}\n", "go") is None
    assert P.composition("function a(n,t){var e=n*2;return e>t?e-t:t+1}" * 30, "js") == "minified"
    series = "\n\n".join(f"def f_{k:04d}(count):\n    total = count * {k + 1}\n    return total + {k}" for k in range(6))
    assert P.composition("import math\n\n" + series, "py") == "generated"
    assert P.composition("TABLE = [1, 2, 3, 4]\n\n" + CODE, "py") is None
    assert P.composition(None, "py") is None and P.composition("", "py") is None


def test_classes(spark):
    up = "import os\n\n\ndef upstream_thing(path, mode):\n    if mode == 3:\n        raise ValueError(path)\n    return os.path.join(path, 'x')\n\n\ndef known_helper(c):\n    while c > 7:\n        c = c // 2\n    return c\n\n\nclass Delta:\n    width = 9\n\n    def go(self, x):\n        return {y: 1 for y in x}\n"
    edited = "# another banner\n\n" + up.replace("    return c\n", "    # why\n    return c   \n").replace("\n", "\r\n")
    rows = [
        (1, "a", "a/src/own.py", CODE), (2, "a", "a/lib/copy.py", edited), (3, "b", "b/node_modules/x/i.js", "x()"), (4, "b", "b/src/vendors/own.py", CODE), (5, "b", "b/x_pb2.py", CODE), (6, "b", "b/x.min.js", "a()"),
        (7, "c", "c/empty.py", ""), (8, "c", "c/null.py", None), (9, None, "c/partial.py", up[:60]), (9, None, "c/partial.py", up[:60]), (10, "c", None, CODE), (11, "c", "c/blob.c", "\x00\x01" * 50),
    ]
    files = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, root_id string, path string, content string, way string")
    upstream = spark.createDataFrame([(1, "p", "1", up), (2, "q", "1", None), (3, "q", "1", "")], "upstream_id bigint, pkg string, pkg_version string, content string")
    got = {r.path: r["class"] for r in P.classify(files, upstream).collect()}
    assert got == {"a/lib/copy.py": "third-party", "b/node_modules/x/i.js": "third-party", "b/x_pb2.py": "generated", "b/x.min.js": "minified", "c/blob.c": "blob"}
    assert P.classify(files.limit(0), upstream).count() == 0
    assert "a/lib/copy.py" not in {r.path for r in P.classify(files, upstream.limit(0)).collect()}


def test_copies_of_dependencies_in_other_repositories(spark):
    dep = "".join(f"def helper_{w}(items, limit):\n    return [x * {k} for x in items if x > limit + {k * 7}]\n\n\n" for k, w in enumerate("alpha beta gamma delta epsilon zeta".split(), 1))
    edited = "# local notes\n" + dep.replace("helper_zeta(items, limit)", "helper_zeta(items, limit, extra)")
    part = dep[: len(dep) // 2]
    rows = [(1, "a", "a/vendor/lib/h.py", dep), (2, "b", "b/src/h.py", edited), (3, "c", "c/src/part.py", part), (4, "a", "a/vendor/lib/one.py", "import os\nVALUE = 12345\n"), (5, "c", "c/src/one.py", "import os\nVALUE = 12345\n"), (6, "d", "d/node_modules/h.py", dep), (6, "d", "d/node_modules/h.py", dep), (7, "e", "e/src/own.py", CODE)]
    files = spark.createDataFrame(rows, "file_id bigint, root_id string, path string, content string")
    none = spark.createDataFrame([], "upstream_id bigint, pkg string, pkg_version string, content string")
    got = {r.path for r in P.classify(files, none).collect()}
    assert got == {"a/vendor/lib/h.py", "b/src/h.py", "a/vendor/lib/one.py", "d/node_modules/h.py"}


def test_headers_of_the_file_itself():
    go = "package a\n\nfunc F(x int) int {\n\treturn x + 1\n}\n"
    for line in ("// Utilities that inspect files generated by protoc.", "// The tool marks what it wrote with DO NOT EDIT.", "// Reads output that was automatically generated by x.", "// See how the stubs get generated from the schema."):
        assert P.composition(line + "\n\n" + go, "go") is None, line
    for line in ("// DO NOT EDIT, made from a.tmpl (the writer tool).", "// This file was automatically generated by x; changes will be lost.", "/* Généré par x */", "// Diese Datei wurde automatisch erzeugt", "// このファイルは自動生成されました", "// Changes to this file will be overwritten."):
        assert P.composition(line + "\n\n" + go, "go") == "generated", line


def test_headers_in_block_comments():
    js = "export function a(x) {\n  return x + 1;\n}\n"
    for head in ("/*\n This file was generated by X.\n Do not edit.\n*/\n", "/* Copyright.\n\n   Code generated by x. */\n", "<!--\n generated by x\n-->\n"):
        assert P.composition(head + js, "js") == "generated"
        assert P.composition(js + head, "js") == "generated"
    for q in ('"""', "'''", 'r"""'):
        assert P.composition(f"{q}\nBindings.\n\nGenerated by X, do not edit.\n{q[-3:]}\n" + CODE, "py") == "generated"
    assert P.composition('"""Own helpers.\n\nThey are kept small.\n"""\n' + CODE + '\nMARK = "generated by x"\n', "py") is None
    assert P.composition("/*\n Own helpers.\n*/\n" + js + 'const m = "@generated";\nlet k = 1; /* one */\n', "js") is None
    assert P.composition(CODE + '\nTEMPLATE = """\n# Code generated by x. DO NOT EDIT.\n"""\n', "py") is None
