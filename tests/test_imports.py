from tidemark.operators.cycles import cycles
from tidemark.operators.imports import dead_files, import_graph, resolve

FILES = """src/app.py src/utils.py src/pkg/__init__.py src/pkg/deep/mod.py src/index.ts src/lib/button.tsx src/lib/button.css app/src/only.ts web/page.js web/greeter/greeter.go
src/greeter.go cmd/main.go src/main/java/com/acme/Tool.java crate/net/mod.rs net/http.rs include/util.h top.py a/b/c.py Makefile src/lib/index.js tests/test_app.py config.json src/unused.py""".split()
CASES = [
    ("src/app.py", ".utils", "src/utils.py"), ("src/app.py", ".", "src/index.ts"), ("src/pkg/deep/mod.py", "..", "src/pkg/__init__.py"), ("src/pkg/deep/mod.py", "...utils", "src/utils.py"),
    ("src/app.py", "os", None), ("src/app.py", "os.path", None), ("src/app.py", "src.pkg.deep.mod", "src/pkg/deep/mod.py"), ("src/app.py", "src.pkg.deep.mod.Thing", "src/pkg/deep/mod.py"), ("src/app.py", "pkg.missing", "src/pkg/__init__.py"),
    ("web/page.js", "@/lib/button", "src/lib/button.tsx"), ("web/page.js", "~/only", "app/src/only.ts"), ("web/page.js", "./page", None), ("web/page.js", "../src/index", "src/index.ts"), ("web/page.js", "../../../top", "top.py"),
    ("web/page.js", "'./greeter'", "web/greeter/greeter.go"), ("web/page.js", "/src/lib/button.css", "src/lib/button.css"), ("web/page.js", "../src/lib", "src/lib/index.js"),
    ("cmd/main.go", "example.com/acme/src/greeter", "src/greeter.go"), ("cmd/main.go", "<util.h>", None), ("include/x.c", "util.h", "include/util.h"), ("src/x.java", "com.acme.Tool", "src/main/java/com/acme/Tool.java"), ("src/x.java", "com.acme.Tool.run", "src/main/java/com/acme/Tool.java"),
    ("src/m.rs", "crate::net::http", "net/http.rs"), ("src/m.rs", "net::http::Client", "net/http.rs"), ("src/m.rs", "std::collections::HashMap", None), ("x.py", "top", "top.py"), ("x.py", "a.b.c", "a/b/c.py"), ("x.py", "Makefile", "Makefile"), ("x.py", "", None), ("x.py", None, None),
]


def test_strategies_in_order(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    asked = spark.createDataFrame([(p, m) for p, m, _ in CASES] * 2, "path string, module string")
    got = {(r["path"], r["module"]): r["dst"] for r in resolve(asked, files).collect()}
    assert got == {(p, m): d for p, m, d in CASES if d}
    assert resolve(asked.limit(0), files).count() == 0 and resolve(asked, files.limit(0)).count() == 0


def test_graph_cycles_and_dead_files(spark):
    files = spark.createDataFrame([(f,) for f in FILES], "path string")
    asked = spark.createDataFrame([("src/app.py", ".utils"), ("src/utils.py", ".pkg"), ("src/pkg/__init__.py", "..app"), ("src/app.py", "os"), ("src/utils.py", ".utils")], "path string, module string")
    edges = import_graph(asked, files)
    assert {tuple(r) for r in edges.collect()} == {("src/app.py", "src/utils.py"), ("src/utils.py", "src/pkg/__init__.py"), ("src/pkg/__init__.py", "src/app.py")}
    assert [r["cycle"] for r in cycles(edges).collect()] == [["src/app.py", "src/utils.py", "src/pkg/__init__.py", "src/app.py"]]
    dead = {r["path"] for r in dead_files(files, edges).collect()}
    assert "src/unused.py" in dead and not dead & {"src/utils.py", "src/app.py", "tests/test_app.py", "config.json", "src/pkg/__init__.py"}
