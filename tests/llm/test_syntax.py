"""Problem 5: files that do not parse."""

import random

import pytest

from tessel.llm import syntax as S

GOOD = {
    "python": 'def f(x):\n    """doc\n<<<<<<< HEAD\n"""\n    return {"a": [x]}\n',
    "go": 'package m\n\nimport (\n\t"fmt"\n)\n\n// it\'s {\nfunc A(x string) (int, error) {\n\tm["}"] = `{`\n\tfor _, v := range x {\n\t\tfmt.Println(v, \'{\')\n\t}\n\treturn 0, nil\n}\n',
    "java": 'package a.b;\n\nimport java.util.List;\n\n@Deprecated\npublic class A<T extends List<T>> implements B {\n  /* } */ char c = \'{\';\n  String s = """\n   text "{" here\n  """;\n  void f() { if (a) { b(); } else { c(); } }\n}\n',
    "rust": "use std::fmt;\n\n#[derive(Debug)]\npub struct A<'a> { s: &'a str }\n\nimpl<'a> A<'a> {\n    pub fn f(&self) -> char { let r = r#\"}\"#; '{' }\n}\n\nmacro_rules! m { () => {} }\n",
    "js": "import A from \"./a\";\n\nexport class B extends A {\n  async f(x) { return `t ${x + `{${1}`}`.replace(/[{\"]/g, \"\"); }\n}\nconst g = async (a) => { await a; };\nlabel: for (const x of y) { continue label; }\n",
    "c": '#include <stdio.h>\n#define M(x) do { \\\n  x; } while (0)\n#ifdef A\nint f(int a) {\n#else\nint f(void) {\n#endif\n  char *s = "\\"{"; /* { */\n  return 0;\n}\nstatic const char *t = "a" "b";\n',
    "cpp": "#include <vector>\nnamespace n {\nclass A { public: int x{0}; A() = default; };\n}\ntemplate <typename T> auto f(T a) -> int { auto l = [=](int q) { return R\"(})\"[0] + 1'000; }; for (auto &v : a) { v++; } return 0; }\n",
    "ruby": "require 'json'\n\nclass A < B\n  def f(x)\n    return nil if x.nil?\n    x.each do |y|\n      puts \"#{y[\"a\"]} }\"\n    end\n    z = if x then 1 else 2 end\n    t = <<~EOS\n      end def {\n    EOS\n    while x > 1 do x -= 1 end\n  end\n\n  def g = 1\nend\n",
    "lua": 'local a = require("a")\n\n--[[ end ]]\nlocal function f(x)\n  if not x then\n    return nil\n  end\n  local s = [[\n<<<<<<< HEAD\n]]\n  for _, v in ipairs(x) do f(v) end\n  repeat x = x - 1 until x < 0\nend\n',
    "sh": '#!/bin/bash\nf() {\n  if [ -z "$a" ]; then\n    echo "it\'s }" >&2\n  fi\n  for x in "$@"; do echo ${x#*/} $# $(g "$x"); done\n  case "$1" in\n    a|b) echo ok ;;\n    *) echo "no" ;;\n  esac\n  cat <<EOF\n}} (( don\'t\nEOF\n}\n',
    "json": '{"a": [1, 2, {"b": null}]}', "jsonc": '// c\n{"a": 1 /* x */}', "yaml": "a:\n  - b: 1\nc: |\n  x: y: z\n", "toml": '[a]\nb = "c"\n',
}
DAMAGE = {
    "python": ["def def f():\n    pass\n", "x = [1,\n", "def f()\n    pass\n", "if x:\n", "a = 1\n<<<<<<< HEAD\nb = 2\n=======\nb = 3\n>>>>>>> z\n"],
    "go": ["func f() {\n", 'package m\nfunc f() {\n\tg(1, [2)\n}\n', "package m\nfunc f() error {\n\treturn nil\n}\n}\n", 'package m\n\nimport "a\n'],
    "java": ["public class A {\n  void f() {\n}\n", "class A { int x = ; }", "class A { void f() { g(1, [2; } }"],
    "rust": ["fn f() {\n", "pub fn f() -> u8 { g(bar, [1, 2; }\n"], "js": ["function f() {\n", "const a = ;\n", "class A { f( { } }\n", "let s = 'abc\n"],
    "c": ["int f() {\n", "int x = (1;\n", "#includ <a.h>\n"], "cpp": ["class A {\n", "void f() { g(; }\n"],
    "ruby": ["def f\n  1\n", "class A\nend\nend\n", "x = [1,\n"], "lua": ["function f()\n  return 1\n", "if x then\nend\nend\n", "x = {1,\n"],
    "sh": ["f() {\n  echo a\n", "if true; then\n  echo\n", "echo a\nfi\n", 'echo "abc\n'],
    "json": ['{"a": 1,}', "{'a': 1}", '{"a" 1}', ""[:0] + "{"], "jsonc": ["{", "{'a': 1}"], "yaml": ["a: b: c\n", "a:\n\t- b\n"], "toml": ["a: 1\n", "[a\n"],
}


@pytest.mark.parametrize("lang", GOOD)
def test_valid_files_cost_nothing(lang):
    assert S.diagnose(GOOD[lang], lang) is None
    assert S.diagnose("", lang) is None and S.diagnose(" \n\n", lang) is None


@pytest.mark.parametrize("lang,text", [(k, t) for k, v in DAMAGE.items() for t in v])
def test_damage_costs(lang, text):
    got = S.diagnose(text, lang)
    assert got and got[0] >= 1


@pytest.mark.parametrize("lang", [k for k in GOOD if k not in ("json", "jsonc", "yaml", "toml")])
def test_other_contents(lang):
    assert S.diagnose("\x7fELF\x02\x01\x01 {a b}", lang)[1] == "mismatch"
    assert S.diagnose("<!DOCTYPE html>\n<html><body>x</body></html>\n", lang)
    for other in ("go", "java", "rust", "ruby", "c"):
        if other != lang and {other, lang} != {"c", "cpp"}:
            assert S.diagnose(GOOD[other], lang), other


@pytest.mark.parametrize("lang", ["go", "java", "rust", "js", "c", "cpp"])
def test_conflict_and_truncation_are_told_apart(lang):
    text = GOOD[lang]
    cut = text[: text.rfind("}")]
    assert S.diagnose(cut, lang)[1] == "truncation"
    assert S.diagnose(text + "<<<<<<< HEAD\n=======\n>>>>>>> x\n", lang)[1] == "conflict"


WRONG = [
    ('go', 'package m\n\nfunc f() {\n\tx := 1 +\n}\n'),
    ('java', 'class A {\n void f() {\n  int x = 1 + ;\n }\n}\n'),
    ('c', 'int f(void) {\n  int x = 1 2;\n  return x;\n}\n'),
    ('c', 'int f(void) {\n  int x = 1\n  return x;\n}\n'),
    ('c', 'int f(int y) {\n  return y\n}\n'),
    ('rust', 'fn main() {\n    let x 1;\n}\n'),
    ('lua', 'local x\nx = = 1\n'),
    ('ruby', 'def f\n  1 +* 2\nend\n'),
    ('js', 'let x = 1 + ;\n'),
    ('sh', 'for i in 1 2 3\n  echo $i\ndone\n'),
    ('sh', 'for i in 1 2 3\n  echo $i\n'),
    ('jsx', "export const A = () => (\n  <div>\n    <p>Don't {x}</p>\n"),
    ('ts', 'const x: number = = 1;\n'),
    ('cpp', 'int f() { int x = 1 int y = 2; return x; }\n'),
    ('java', 'class A { int f() { return 1 } }\n'),
    ('java', 'class A { int f() { int x = 5\n int y = 6; return x; } }\n'),
    ('go', 'package m\nfunc f() int { return 1 2 }\n'),
    ("tsx", "export const A = () => <div>{[1, 2}</div>;\n"),
]
RIGHT = [
    ('jsx', 'export const A = () => (\n  <div className="x">\n    <p>Don\'t {x} stop</p>\n    {a > 1 && b < 2 ? <b>it\'s</b> : null}\n  </div>\n);\n'),
    ('sh', 'for i in 1 2 3; do\n  echo $i\ndone\nwhile read x; do echo; done\nuntil false\ndo\n:\ndone < f\n'),
    ('cpp', 'auto f = [=](int x) { return x; };\nbool operator==(const A& a, const B& b);\nstd::vector<int> v{1, 2};\n'),
    ('go', 'package m\n\nvar x = []int{\n\t1,\n\t2,\n}\n\nfunc f(a ...int) (r *T, err error) {\n\ty := a[0] +\n\t\ta[1]\n\tch <- y\n\treturn nil, nil\n}\n'),
    ('ruby', 'def f(*a, **b, &c)\n  a.inject(:+)\n  g(*a)\n  x = y * 2\nend\ndef ==(o)\n  true\nend\n'),
    ('rust', 'fn main() {\n    let v: Vec<&\'static str> = vec!["a", "b"];\n    for i in 0..=10 { if i == 2 { continue } }\n    let f = |x: i32| x + 1;\n    let b = b"abc";\n    match x { 1 | 2 => {}, _ if y => () }\n    x?;\n}\n'),
    ('js', 'const a = [1, ...b], c = x ? 1 : 2;\nlet r = a.map((x) => x * 2).filter(Boolean)\nfor (const k of a) { delete a[k] }\nlabel: for (;;) break label\nexport default class A extends B { static x = 1; get y() { return 1 } async *g() { yield* h() } }\n'),
    ('java', 'class A<T extends B & C> { int[] a = {1, 2}; List<? super T> f(int... x) { return (y) -> y + 1; } @X(a = {"b"}) void g() { switch (x) { case 1: break; default: } for (int i = 0; ; i++) ; } }\n'),
    ('c', '#include <a.h>\nstatic const char *const s[] = {"a" "b", NULL};\nint f(int (*g)(void *), ...) { char *p = (char *)q; return -*p + (int)1.5e-3f; }\nstruct s x = {.a = 1, .b = {2}};\n'),
    ('lua', "local a <const>, b = 1, ...\nfunction m.f(x) return #x, -x, not x end\na = b y = c\nprint 'x'\n"),
    ("c", "struct s *f(const struct s *a, int n) { return n > 1 ? &a[n - 1] : (struct s *)0; }\n"),
]


@pytest.mark.parametrize("lang,text", WRONG)
def test_faults_inside_expressions_and_statements(lang, text):
    assert S.diagnose(text, "jsx" if lang == "tsx" else lang)


@pytest.mark.parametrize("lang,text", RIGHT)
def test_valid_expressions_and_statements(lang, text):
    assert S.diagnose(text, lang) is None


def test_nesting_deeper_than_the_parser():
    assert S.diagnose("[" * 100_000, "json") and S.diagnose("[" * 100_000 + "]" * 100_000, "json") is None


def test_long_rests_have_a_cost():
    cost, touched = S.chart(list("(]}{" * 60))
    assert 0 < cost <= 240 and touched == sorted(set(touched))
    assert S.chart(list(")" * 301 + "(" * 500))[0] == 151 + 250


def brute_repair(symbols):
    """Least edits over all texts of the bracket grammar, by breadth-first search."""
    def ok(s):
        return not S.cancel([(c, 0) for c in s])

    seen, layer, cost = {symbols}, {symbols}, 0
    while True:
        if any(ok(s) for s in layer):
            return cost
        cost += 1
        new = set()
        for s in layer:
            for i in range(len(s) + 1):
                new |= {s[:i] + c + s[i:] for c in "()[]"}
                if i < len(s):
                    new |= {s[:i] + s[i + 1 :]} | {s[:i] + c + s[i + 1 :] for c in "()[]"}
        layer = new - seen
        seen |= layer


def test_chart_finds_the_least_repair():
    rng = random.Random(3)
    for _ in range(60):
        s = "".join(rng.choice("()[]") for _ in range(rng.randint(0, 5)))
        left = S.cancel([(c, i) for i, c in enumerate(s)])
        assert S.chart([c for c, _ in left])[0] == brute_repair(s), s


def plain_repair(symbols):
    """Least edits by the recurrence itself, for every part."""
    n = len(symbols)
    cost = [[0] * (n + 2) for _ in range(n + 2)]
    pairs = {(a, b): 0 if a + b in ("()", "[]", "{}") else 2 if a in ")]}" and b in "([{" else 1 for a in "()[]{}" for b in "()[]{}"}
    for i in range(n - 1, -1, -1):
        for j in range(i + 1, n + 1):
            cost[i][j] = min([cost[i + 1][j] + 1, *(pairs[symbols[i], symbols[k]] + cost[i + 1][k] + cost[k + 1][j] for k in range(i + 1, j))])
    return cost[0][n]


def test_long_runs_have_the_least_cost():
    rng = random.Random(6)
    for _ in range(40):
        runs = [rng.choice("()[]{}") * rng.randint(1, 12) for _ in range(4)] + ["".join(rng.choices(rng.choice(["([{", ")]}"]), k=6))]
        rng.shuffle(runs)
        left = [c for c, _ in S.cancel([(c, 0) for c in "".join(runs)])]
        assert S.chart(left)[0] == plain_repair(left), left
    cost, touched = S.chart(list("[{" * 50_000 + ")"))  # too long for a chart
    assert cost == 50_001 and touched == sorted(set(touched))


def test_long_rests_have_the_least_cost(monkeypatch):
    rng = random.Random(4)
    left = [c for c, _ in S.cancel([(rng.choice("()[]{}"), 0) for _ in range(500)])]
    assert len(left) > 200
    got = S.chart(left)
    assert got[0] == plain_repair(left)
    monkeypatch.setattr(S, "_SPARSE", 0)  # cheap parts first, whatever the length
    assert S.chart(left) == got
    monkeypatch.undo()
    for deep in (300, 20_000):  # one stray symbol inside
        assert S.chart(list("[" * deep + ")" + "]" * deep)) == (1, [deep])
    assert S.diagnose("[" * 300 + ")" + "]" * 300, "json")[0] == 1


def test_table(spark):
    rows = [("/r/n/p/a.go", GOOD["go"].encode()), ("/r/n/p/b.go", b"func"), ("/r/n/p/b.go", b"func"), ("/r/n/p/c.PY", b"\xff\xfe\xef\xbb\xbfx = 1\n"), ("/r/n/p/d.py", None), ("/r/n/p/e.py", b""),
            ("/r/n/p/f.ini", b"{{{"), (None, b"x"), ("/r/n/p/g.py", b"\xef\xbb\xbfx = 1\r\ny = 2\r\n"), ("/r/n/p/noext", b"{")]
    df = spark.createDataFrame([(p, c, "n", "p", 1) for p, c in rows], "path string, content binary, namespace string, project_id string, cost int")
    assert [r.file_path for r in S.unparsable_files(df).select("file_path").distinct().collect()] == ["/r/n/p/b.go"]
    rates = {r.language: (r.files, r.faulty) for r in S.fault_rates(df).collect()}
    assert rates == {"go": (2, 1), "python": (4, 0)}
    assert S.unparsable_files(df.limit(0)).count() == 0 and S.fault_rates(df.limit(0)).count() == 0
