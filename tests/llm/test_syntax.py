import pytest

from lodestrata.llm import syntax as S
from lodestrata.llm.lexers import lex

VALID = {
    "py": ["", "# only\n", "def f(a, *b, c=1, **d):\n    \"\"\"x\"\"\"\n    return [x for x in a if x] or {1: 2}\n", "class A(B, metaclass=M):\n    x: int = 1\n    @p\n    async def f(self): await g(); return\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nfinally:\n    x = lambda a, b=1: a + b\n", "from . import x as y\nimport a.b, c\nx = 'a' 'b'\nprint(f'{x}')\nwith open(p) as f, q:\n    a[1:2, ::3] += not b\n", "x = 1 if y else 2\nfor i, j in z:\n    continue\nelse:\n    del x\n"],
    "js": ["const x = require(\"./y\");\nclass A {\n  constructor() {\n    this.a = 0;\n  }\n}\nmodule.exports = { x, y: 1, ...z };\n", "!function(e){e.a=1}(window);const f=(j,$)=>j?$+1:void 0,k=[8,!0,!1];(()=>{try{M.e()}catch(e){console.error(e)}})();", "let a = 1\nlet b = a\nfor (const x of y) { if (x) continue; else break }\nvar r = /a[/]b/g.test(s)\n", "{ let a = 1; { b() } }\nf(); { x: for (;;) break x }\n"],
    "ts": ["import { a } from \"./b\";\nexport interface X {\n  a: number;\n  b?: string;\n}\nexport function f(a: number, b: string = \"x\"): number {\n  let t = a * 2;\n  return t;\n}\n", "export const x: string = \"y\";\nconst m = new Map<string, number>();\ntype A = B | C;\n"],
    "go": ["package x\n\nimport \"fmt\"\n\ntype A struct {\n\tb int\n}\n\nfunc (a *A) F(x int, y string) (int, error) {\n\tfor i := 0; i < x; i++ {\n\t\tfmt.Println(i)\n\t}\n\tif x > 1 {\n\t\treturn x, nil\n\t}\n\tvar t = []int{1, 2}\n\treturn t[0], nil\n}\n"],
    "rs": ["use a::b::C;\n\npub struct S {\n    x: i64,\n}\n\npub fn f(a: i64, b: &str) -> i64 {\n    let mut t = a * 2;\n    for i in 0..b.len() {\n        t = t + i as i64;\n    }\n    if t > 1 {\n        return t;\n    }\n    match t { 1 => 2, _ => 3 }\n}\n"],
    "java": ["package a.b;\n\npublic class A {\n    public static final String X = \"y\";\n    public static long f(long a, int[] b) {\n        for (long i = 0; i < a; i++) {\n            a = a + i;\n        }\n        if (a > 1) {\n            return a;\n        }\n        return b[0] + 1;\n    }\n}\n"],
    "c": ["#include <stddef.h>\n\nstruct S {\n    long a;\n};\n\nstatic const char *X = \"y\";\n\nlong f(long a, const char *b) {\n    long t = a * 2;\n    for (long i = 0; i < a; i++) {\n        t = t + i;\n    }\n    if (t > 1) {\n        return t;\n    }\n    return t + b[0];\n}\n"],
    "json": ["{\"a\": [1, -2.5e3, true, null, \"x\\n\"], \"b\": {}}"],
    "toml": ["# c\na = 1\n[x.y]\nb = \"s\"\nc = [1, 2,\n 3]\nd = { e = 1, f = 'g' }\n[[z]]\n"],
}
BROKEN = {
    "py": ["def f(:\n    pass\n", "x = \n", "print 'a'\n", "if x:\npass\n", "def f():\n    a\n  b\n", "x = 'abc\n", "<<<<<<< HEAD\nx = 1\n", "001 | import x\n", "x = (1\n", ")\n", "\x7fELF\x00\x01"],
    "js": ["function f(a: number): number { return a; }\n", "let x = ;\n", "function f() {\n", "x = 1;\n)\n", "const a = \"x\ny\";\n", "# Notes\n\nSome words here.\n", "{% if x %} = 4\n", "{{ x }} = 4\n", "{\n  \"a\": {\n    \"b\": 8\n  }\n}\n"],
    "ts": ["<!DOCTYPE html>\n<html></html>\n", "let total\nlet\n", "@@ -1,2 +1,2 @@\n+import x\n", "{\"a\": 1, \"b\": [2]}"],
    "go": ["func f() {\n}\n", "package x\n\nfunc f(a int) int {\n\tlet b = 1;\n}\n", "package x\n}\n"],
    "rs": ["pub fn f(a: i64) -> i64 {\n    let x = ;\n}\n", "def f(a):\n    return a\n", "fn f() { let x = (1; }\n"],
    "java": ["public class A {\n    long f( { }\n}\n", "package x\n\nfunc f() int {\n}\n", "class A { <<<<<<< HEAD\n}\n"],
    "c": ["long f(long a) {\n    return a +;\n}\n", "long f(long a) {\n    long b\n    return a;\n}\n", "long f(long a) {\n"],
    "json": ["", "{\"a\": 1,}", "{'a': 1}", "[1 2]", "{\"a\": 1} x"],
    "toml": ["a = \n", "a = 1 b = 2\n", "[x\n", "a b = 1\n", "x = nope\n"],
}


def judged(language, text):
    """The whole chain for one file, without Spark."""
    pairs = S.permitted_pairs(language)
    shape = lex(text, language)
    plain = "^" + shape.translate(str.maketrans("<%~", "({{")) + "$"
    if any((a, b) not in pairs for a, b in zip(plain, plain[1:])):
        return False
    stack = [("", [])]
    for letter in shape:
        if letter in "([{<%~":
            stack[-1][1].append({"(": "P", "[": "K", "{": "Z", "<": "P", "%": "Z", "~": "Z"}[letter])
            stack.append((letter, []))
        elif letter in ")]}":
            if len(stack) < 2 or {"(": ")", "<": ")", "[": "]", "{": "}", "%": "}", "~": "}"}[stack[-1][0]] != letter:
                return False
            opener, inner = stack.pop()
            if not S.group_valid(language, opener, "".join(inner)):
                return False
        else:
            stack[-1][1].append(letter)
    return len(stack) == 1 and S.group_valid(language, "", "".join(stack[0][1]))


@pytest.mark.parametrize("language,text", [(k, t) for k, v in VALID.items() for t in v])
def test_valid(language, text):
    assert judged(language, text)


@pytest.mark.parametrize("language,text", [(k, t) for k, v in BROKEN.items() for t in v])
def test_broken(language, text):
    assert not judged(language, text)


def test_plan_agrees(spark):
    rows = []
    for valid, part in ((True, VALID), (False, BROKEN)):
        for k, v in part.items():
            rows += [(len(rows) + n, "r", f"{'ok' if valid else 'bad'}/{k}{n}.{k}", t) for n, t in enumerate(v)]
    rows = [(i, r, p, t) for i, (_, r, p, t) in enumerate(rows)] + [(900, None, "x.md", "anything (("), (901, "r", None, "x"), (902, None, "empty.py", None), (903, "r", "ok/big.py", "x = 1\n" * 20_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id bigint, root_id string, path string, content string, letters string")
    bad = {r.path for r in S.invalid_files(df).collect()}
    assert bad == {r[2] for r in rows if r[2] and r[2].startswith("bad/")}
    rates = {(r.root_id, r.language): (r.n_files, r.n_invalid) for r in S.invalid_rates(df).collect()}
    assert rates[("r", "json")] == (len(VALID["json"]) + len(BROKEN["json"]), len(BROKEN["json"])) and rates[(None, "py")] == (1, 0)
    assert S.invalid_files(df.limit(0)).count() == 0
