import pytest

from lodestrata.llm import docpairs as D

HEADERS = [
    ("def f(a, b=3, *args, key: str = \"x\", **kw) -> int", "f", ["a", "b", "args", "key", "kw"], 0), ("pub fn rank<T: Ord>(a: &'a str, mut b: Vec<Vec<T>>) -> Result<(), E>", "rank", ["a", "b"], 0),
    ("public static Map<String, List<Integer>> go(final long a, int[] b) throws X", "go", ["a", "b"], 0), ("func (s *Server) Do(ctx context.Context, a, b int) (int, error)", "Do", ["ctx", "a", "b"], 0),
    ("long f(const char *a, unsigned long b)", "f", ["a", "b"], 0), ("def split(\n    offset,\n    password=\"none\"\n)", "split", ["offset", "password"], 0), ("pub fn x(a: i64, b: i64", "x", ["a", "b"], 1), ("def f(a, b", "f", ["a", "b"], 1), ("public void doIt(int n, String s", "doIt", ["n", "s"], 1),
]


@pytest.mark.parametrize("signature,name,parameters,repairs", HEADERS)
def test_headers(signature, name, parameters, repairs):
    assert D.header(signature) == (name, parameters, repairs)


def test_no_header():
    assert D.header(None) == (None, [], -1) and D.header("") == (None, [], -1) and D.header("((((")[0] is None


TRIVIAL = [
    None, "", "   ", "/** */", "-----------", "=====", "*", "...", "TODO", "TODO: document this", "FIXME: add docs", "Rank posting.", "rankPosting", "This function ranks the posting.", "The rank posting function.", "rank posting\n~~~~~~~~~~~~",
    "@param limit\n@param count\n@return", ":param limit:\n:returns:", "Rank posting.\n\n@param limit the limit", "See above.", "See otherThing.", "{@inheritDoc}", "<inheritdoc/>", "noqa: E501", "eslint-disable-next-line no-shadow", "clippy: allow too many arguments",
    "return total - 1;", "total = fold(total, limit);", "N/A", "(none)", "Undocumented.", "Auto-generated method stub", "Lorem ipsum", "Helper function.", "/// tbd",
]
REAL = [
    "Ties go to the older edge.", "Rank posting.\n\nNot safe to call under heavy load.", "TODO lists inside a span are flattened before the hash is taken.", "Empty input yields 9.", "Rank posting.\n\n@param limit in tokens, not bytes", "空の節は数えず、残りを新しい順に返す。",
    "Zählt nur Abschnitte, die seit dem letzten Lauf geändert wurden.", "Returns -1 if no claim fits into the remaining 4 tokens.", "/// Panics above 4 tiers.", "Unlike `fold_session`, this never touches pinned sections.",
]


@pytest.mark.parametrize("doc", TRIVIAL)
def test_trivial(doc):
    assert D.content(doc, "rankPosting", ["limit", "count"]) == ""


@pytest.mark.parametrize("doc", REAL)
def test_real(doc):
    assert D.content(doc, "rank_posting", ["limit", "count"])


def test_pairs(spark):
    row = lambda i, kind, doc, sig="def f(limit)", name="f": (i, "p.py", name, kind, "pub", sig, doc, "m", 1, 2, 1)
    rows = [row("a", " Function", "Ties go to the older edge."), row("a", " Function", "Ties go to the older edge."), row("b", "method ", None), row("c", "class", "Ties go to the older edge."), row("d", "METHOD", "TODO"), row("e", None, "Ties."), row("g", "function", "Walks down.", None, None), row("h", "function", "word " * 100_000)]
    rows += [row(f"t{k}", "function", "Frobs quietly.", name=f"n{k}") for k in range(9)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, file_path string, name string, kind string, visibility string, signature string, doc_comment string, module_path string, line_start int, line_end int, cyclomatic_complexity int, content string")
    got = D.pairs(df).collect()
    assert sorted(r.symbol_id for r in got) == ["a", "g", "h"]
    assert D.pairs(df.limit(0)).count() == 0


def test_files(spark):
    broken = "// Ties go to the older edge.\nfunc Good(a int) int {\n\treturn a\n}\n\n// Walks every shard from the end.\nfunc Cut(b int) int {\n\treturn b +\n"
    rows = [("x.go", broken), ("y.py", "def f(a):\n    \"\"\"Keeps the newest row of each key.\"\"\"\n    return a\n\ndef g(\n"), ("z.go", None), ("w.txt", "func X() {}")]
    got = {(r.path, r.name): r.complete for r in D.file_pairs(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("x.go", "Good"): True, ("x.go", "Cut"): False, ("y.py", "f"): True}


FILES = {
    "a.js": (
        "/* Ties. */\nfunction outer(a) {\n  function inner(b) {\n    return b;\n  }\n  return inner(a);\n}\nconst f = (a, { b, c }) => {\n  return a;\n};\nlet g = x => x + 1\nclass A extends B {\n  x = 1\n  constructor(a) {\n    super(a)\n  }\n  static async go(n = f(1)) { return n }\n}\n"
        "module.exports = { run: function (z) { return z; }, stop(q) { return 1 } };\nif (a) { b() }\nexports.h = function named(k) { return k }\n",
        ["outer", "inner", "f", "g", "constructor", "go", "run", "stop", "h"], {"g"},
    ),
    "b.ts": ("export async function f<T>(a: number, b?: { x: string }): Promise<Map<string, T>> {\n  return a;\n}\nexport const q = (a: string): number => a.length;\n", ["f", "q"], set()),
    "c.java": ("public class A {\n  public <T extends B> T first(List<T> xs, int n) throws E, F {\n    if (n > 1) { return null; }\n    return xs.get(0);\n  }\n  A(int x) { this.x = x; }\n  @Override\n  public int[] go(final long a) { return b; }\n}\n", ["first", "A", "go"], set()),
    "d.c": ("#include <x.h>\nstatic const char *\nname(int a,\n     char *b)\n{\n  return b;\n}\nstruct S { int a; };\nstruct S *mk(int c) { return 0; }\nint t[] = {1, 2};\n", ["name", "mk"], set()),
    "e.go": ("package x\nfunc (s *Server) Do(a, b int) (int, error) {\n\tif a > 1 {\n\t\treturn 1, nil\n\t}\n\treturn a, nil\n}\nfunc Cut(b int) int {\n\treturn b +\n\n// doc\nfunc Good(c int) map[string]int {\n\treturn nil\n}\n", ["Do", "Cut", "Good"], {"Cut"}),
    "f.rs": ("impl<'a> S<'a> {\n    #[inline]\n    pub(crate) fn rank<T: Ord>(&self, a: &'a str) -> Result<(), E> where T: Clone {\n        let x = '{';\n        Ok(())\n    }\n}\nfn bad() { let x = (1; }\nfn ok(n: i64) -> i64 { n }\nfn odd() { let x = ; }\n", ["rank", "bad", "ok", "odd"], {"bad", "odd"}),
    "g.py": ("@deco(1)\nasync def f(a, *b, c=1) -> int:\n    def inner(z):\n        return z\n    return (\n\ndef g(x): return x\n\nclass A:\n    def m(self, k):\n        return k\n\ndef h(\n", ["f", "inner", "g", "m", "h"], {"f", "h"}),
}


@pytest.mark.parametrize("path", sorted(FILES))
def test_functions_of_files(path):
    text, names, broken = FILES[path]
    got = list(D.functions(path, text))
    assert [f[0] for f in got] == names
    assert {f[0] for f in got if not f[7]} - {"g"} == broken - {"g"}


def test_no_functions():
    assert list(D.functions("x.js", "if (a) { b() }\nwhile (c) { d() }\nfoo(x);\nconst o = { a: 1 };\n")) == []
    assert list(D.functions("x.go", "}}}}))))((((")) == [] and list(D.functions("x.py", "")) == [] and list(D.functions("x.rs", "{" * 5000)) == []


def test_nested_functions_and_long_comments():
    js = "/* Ties go to the older edge.\n" + "filler words\n" * 3000 + "*/\nfunction outer(a) {\n  function inner(b) {\n    return b;\n  }\n  return inner(a);\n}\n"
    got = {f[0]: f for f in D.functions("x.js", js)}
    assert (got["outer"][2], got["outer"][7]) == (js.count("\n"), True) and "Ties go" in got["outer"][4] and got["inner"][7]
    py = "def outer(a):\n    def inner(b):\n        return b\n\n    return inner(a)\n\n\nx = 1\n"
    assert [(f[0], f[1], f[2]) for f in D.functions("x.py", py)][0][:2] == ("outer", 1) and next(D.functions("x.py", py))[2] >= 5
