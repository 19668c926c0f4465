from tidemark.functions.paths import endpoint, noise
from tidemark.functions.text import entropy, license_status, luhn
from pyspark.sql import functions as F

from tidemark.sources.logs import parse_lines

LINES = {
    '127.0.0.1 - frank [10/Oct/2023:13:55:36 +0000] "GET /api/users HTTP/1.1" 200 1234': ("nginx", "127.0.0.1", "GET", "/api/users", 200),
    '127.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "POST /x HTTP/1.1" 404': ("apache", "127.0.0.1", "POST", "/x", 404),
    '10.0.0.1:5000 - "GET /health HTTP/1.1" 500 Internal': ("uvicorn", "10.0.0.1", "GET", "/health", 500),
    '{"client_ip": "1.2.3.4", "method": "GET", "path": "/j", "status": 201}': ("json", "1.2.3.4", "GET", "/j", 201),
    '{"ClientIP": "5.6.7.8", "ClientRequestURI": "/c", "EdgeResponseStatus": 302}': ("cloudflare", "5.6.7.8", "GET", "/c", 302),
    '2024-01-01T00:00:00Z INFO http.log.access handled {"method":"PUT","uri":"/k","status":204,"remote_ip":"9.9.9.9"}': ("caddy", "9.9.9.9", "PUT", "/k", 204),
}


def test_lines_of_all_servers(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, "garbage", "", None, "{broken"]], "value string")
    got = {(r["source"], r["ip"], r["method"], r["path"], r["status"]) for r in parse_lines(df).collect()}
    assert got == set(LINES.values())


def test_paths(spark):
    cases = {"/users/42?x=1": "/users/:param", "api/{id}/": "/api/:param", "/a/deadbeef99#f": "/a/:param", "": "/", "./x/[slug]": "/x/:param"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", endpoint(F.col("p")).alias("e")).collect()
    assert {r["p"]: r["e"] for r in rows} == cases
    files = {"a/yarn.lock": "lockfile", "x.min.js": "generated", "README.md": "docs", "tests/a.py": "tests", "src/test_a.py": "tests", "src/app.py": None}
    rows = spark.createDataFrame([(k,) for k in files], "p string").select("p", noise(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == files


def test_text_measures(spark):
    df = spark.createDataFrame([("aabb", "4111111111111111", "GPL-3.0-only"), ("aaaa", "4111111111111112", "MIT"), ("", "79927398713", None)], "s string, d string, l string")
    got = df.select(entropy(F.col("s")).alias("e"), luhn(F.col("d")).alias("ok"), license_status(F.col("l")).alias("l")).collect()
    assert [tuple(r) for r in got] == [(1.0, True, "restricted"), (0.0, False, "allowed"), (0.0, True, "missing")]


def test_trees_imports_and_drift(spark, tmp_path):
    from tidemark.sources.trees import changed, drift, import_edges, read_tree

    files = {"app/__init__.py": "x = 1\n", "app/a.py": "import os\nfrom app.b import f\nimport app\n", "app/b.py": "import app.a\n", "node_modules/z.js": "x", "empty.py": "", "data.bin": "q", "yarn.lock": "x", "web/i.ts": "import y from './z'\n", "README.md": "# hi"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = read_tree(spark, str(tmp_path))
    got = {r["path"]: r["language"] for r in tree.collect()}
    assert got == {"app/a.py": "python", "app/b.py": "python", "web/i.ts": "typescript", "README.md": "markdown"}
    assert {r["path"] for r in read_tree(spark, str(tmp_path), keep_noise=False).collect()} == set(got) - {"README.md"}
    assert {(r["src"], r["dst"]) for r in import_edges(tree).collect()} == {("app/a.py", "app/b.py"), ("app/b.py", "app/a.py")}
    before = tree.select("path", F.when(F.col("path") == "app/a.py", "old").otherwise(F.col("md5")).alias("md5")).where("path <> 'web/i.ts'").unionByName(spark.createDataFrame([("gone.py", "m")], "path string, md5 string"))
    assert {r["path"] for r in changed(tree, before).collect()} == {"app/a.py", "web/i.ts"}
    assert {r["path"]: r["state"] for r in drift(tree, before).collect() if r["state"] != "unchanged"} == {"app/a.py": "changed", "web/i.ts": "added", "gone.py": "removed"}


def test_manifests(spark):
    from tidemark.sources.manifests import dependencies, drifting

    rows = [
        ("a/package.json", '{"dependencies": {"react": "^18.2.0"}, "devDependencies": {"jest": "29.0.0"}}'), ("b/package.json", '{"dependencies": {"react": "17.0.1"}}'), ("c/package.json", "{broken"),
        ("requirements.txt", "# note\nDjango==4.2\nrequests[socks]>=2.0 ; python_version > '3'\n-r other.txt\n\nflask\n"), ("go.mod", "module example.com/x\n\nrequire (\n\tgithub.com/a/b v1.2.3\n)\n"),
        ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1.0"\ntokio = { version = "1.3", features = [] }\n[dev-dependencies]\nrand = "0.8"\n'), ("other.txt", "Django==1"),
    ]
    deps = dependencies(spark.createDataFrame(rows, "path string, content string"))
    got = {(r["ecosystem"], r["package"], r["version"]) for r in deps.collect()}
    assert got == {("npm", "react", "18.2.0"), ("npm", "jest", "29.0.0"), ("npm", "react", "17.0.1"), ("pip", "django", "4.2"), ("pip", "requests", "2.0"), ("pip", "flask", ""), ("go", "github.com/a/b", "v1.2.3"), ("cargo", "serde", "1.0"), ("cargo", "tokio", "1.3"), ("cargo", "rand", "0.8")}
    assert [tuple(r) for r in drifting(deps).collect()] == [("npm", "react", ["17.0.1", "18.2.0"])]


def test_more_manifests_and_named_files(spark):
    from tidemark.functions.paths import language
    from tidemark.sources.manifests import dependencies

    rows = [
        ("pyproject.toml", '[project]\nname = "x"\ndependencies = [\n  "numpy>=1.26",\n  "rich",\n]\n[tool.poetry.dependencies]\npython = "^3.10"\nhttpx = "^0.27"\nuvicorn = { version = "0.30", extras = ["standard"] }\n'),
        ("composer.json", '{"require": {"php": ">=8", "monolog/monolog": "^3.0"}, "require-dev": {"phpunit/phpunit": "11.0"}}'), ("Gemfile", "source 'https://x'\ngem 'rails', '~> 7.1'\n  gem \"puma\"\n"),
    ]
    got = {(r["ecosystem"], r["package"], r["version"]) for r in dependencies(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got == {("pip", "numpy", "1.26"), ("pip", "rich", ""), ("pip", "httpx", "0.27"), ("pip", "uvicorn", "0.30"), ("composer", "monolog/monolog", "3.0"), ("composer", "phpunit/phpunit", "11.0"), ("gem", "rails", "7.1"), ("gem", "puma", "")}
    names = {"a/Dockerfile": "docker", "Makefile": "make", "x.py": "python", "README": "unknown"}
    df = spark.createDataFrame([(k,) for k in names], "p string").select("p", language(F.col("p")).alias("l"))
    assert {r["p"]: r["l"] for r in df.collect()} == names
