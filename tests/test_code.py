import pytest
from pyspark.sql import functions as F

from tidemark.operators.taint import tainted_calls
from tidemark.sources.code import calls_without_return, facts

PYTHON = '''# eval(x) in a comment
"""A text: os.system(a)
over lines"""
import os
LIMIT = 5; NAME = "eval(1)"
class Box(Base, mixins.Other):
    def run(self, q, n=3):
        a, b = f(q), g(h(q), "x, y")
        self.rows = [f(i) for i in q]
        return db.cursor.execute("select", a)
def other():
    eval(NAME)
run(1); run(2)
'''
SCRIPT = """// fetch('/no')
/* const z = eval(y) */
const a = 1, {b, c} = req.body;
let s = `template ${x}
call(1)`; var t = new Foo.Bar(1);
class View extends React.Component { render() { return <p className="k">Hello there</p>; } }
useEffect(() => { start(); return () => stop(); }, []);
useEffect(() => { start(1, {k: [2, 3]}) })
function load(id) { return app.db?.query(id).then(f).catch(g) }
const go = (e) => { run(e.target.value); };
"""


def of(rows, kind, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows if r["kind"] == kind)


@pytest.fixture(scope="module")
def rows(spark):
    files = [("a.py", "python", PYTHON), ("b.js", "javascript", SCRIPT), ("c.txt", "text", "eval(1)"), ("d.py", "python", None), ("e.py", "python", ""), ("f.js", "javascript", "f(g(h(")]
    return facts(spark.createDataFrame(files, "path string, language string, content string")).collect()


def test_calls_with_their_scopes_and_arguments(rows):
    py = [r for r in rows if r["path"] == "a.py"]
    assert of(py, "call", "line", "full", "scope") == [
        (8, "f", "run"), (8, "g", "run"), (8, "h", "run"), (9, "f", "run"), (10, "db.cursor.execute", "run"), (12, "eval", "other"), (13, "run", ""), (13, "run", ""),
    ]
    g = next(r for r in py if r["full"] == "g")
    assert [a["text"] for a in g["args"]] == ["h(q)", '"x, y"'] and g["inner"] == ["h"] and g["uses"] == ["q"]
    js = [r for r in rows if r["path"] == "b.js"]
    names = of(js, "call", "line", "full")
    assert [n for n in names if n[0] >= 7] == [(7, "start"), (7, "stop"), (7, "useEffect"), (8, "start"), (8, "useEffect"), (9, "app.db?.query"), (9, "catch"), (9, "then"), (10, "run")]
    assert {r["scope"] for r in js if r["full"] == "app.db?.query"} == {"load"} and {r["scope"] for r in js if r["full"] == "run"} == {"go"}
    assert not any("fetch" in r["full"] or r["full"] == "call" for r in js) and not [r for r in rows if r["path"] in ("c.txt", "d.py", "e.py", "f.js")]


def test_assignments_literals_classes_constructors_and_markup(rows):
    py, js = ([r for r in rows if r["path"] == p] for p in ("a.py", "b.js"))
    assert of(py, "assign", "line", "name", "text") == [(5, "LIMIT", "5"), (5, "NAME", '"eval(1)"'), (8, "b", 'f(q), g(h(q), "x, y")'), (9, "self.rows", "[f(i) for i in q]")]
    assert of(js, "assign", "line", "name", "full")[:6] == [(3, "a", "const"), (3, "b", "b"), (3, "c", "c"), (4, "s", "let"), (5, "t", "var"), (10, "go", "const")]
    assert ("/no",) not in of(js, "literal", "text") and of(py, "literal", "line", "text")[0] == (2, "A text: os.system(a)\nover lines")
    assert of(py, "class", "name", "text") == [("Box", "Base, mixins.Other")] and of(js, "class", "name", "text") == [("View", "extends React.Component")]
    assert of(js, "new", "line", "full") == [(5, "Foo.Bar")] and of(js, "markup", "line", "text") == [(6, "Hello there")]


def test_effects_without_cleanup(spark, rows):
    assert [tuple(r) for r in calls_without_return(spark.createDataFrame(rows)).collect()] == [("b.js", 8)]


FLOWS = {
    "direct.py": ("os.system(request.args['x'])", [("os.system", 1, 0)]),
    "alias.py": ("q = request.args.get('q')\ncursor.execute('select ' + q)\n", [("cursor.execute", 2, 1)]),
    "safe.py": ("q = request.args.get('q')\ncursor.execute(escape(q))\n", []),
    "washed.py": ("q = request.args.get('q')\nq = escape(q)\ncursor.execute(q)\n", []),
    "late.py": ("cursor.execute(q)\nq = request.form['a']\n", []),
    "scopes.py": ("def a():\n    q = input()\n    return q\ndef b(q):\n    eval(q)\n", []),
    "top.py": ("q = sys.argv[1]\ndef b():\n    eval(q)\n", [("eval", 3, 1)]),
    "comment.py": ("q = 1  # request.args\n# eval(q)\nx = 'eval(request.args)'\n", []),
    "script.js": ("const {id} = req.query;\nfunction f() { child.exec(`ls`); db.execute(id, 1); }\n", [("db.execute", 2, 1)]),
    "two.py": ("a = request.json\nb = a['k']\neval(b)\n", [("eval", 3, 2)]),
}


def test_taint_through_aliases_and_sanitizers_over_a_tree(spark, tmp_path):
    """1,000 files: a hundred copies of each flow, read as a tree."""
    from tidemark.sources.trees import read_tree

    for k in range(100):
        (tmp_path / f"m{k}").mkdir()
        for name, (text, _) in FLOWS.items():
            (tmp_path / f"m{k}" / name).write_text(text)
    files = read_tree(spark, str(tmp_path)).repartition(4)
    f = files.sparkSession.createDataFrame(facts(files).collect(), facts(files).schema)
    for hops in (1, None):
        got = {}
        for r in tainted_calls(f, hops=hops).collect():
            got.setdefault(r["path"], []).append((r["name"], r["line"], r["hops"]))
        want = {f"m{k}/{n}": w for k in range(100) for n, (_, w) in FLOWS.items() if [x for x in w if hops is None or x[2] <= hops]}
        assert got == want
    assert {r["name"] for r in tainted_calls(f, hops=0).collect()} == {"os.system"}
    assert tainted_calls(f.where(F.lit(False))).count() == 0
