"""Expressions over file and url paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LOCKFILES = ["package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Cargo.lock", "composer.lock", "Gemfile.lock", "mix.lock", "go.sum", "bun.lockb"]
LANGUAGES = {"py": "python", "js": "javascript", "ts": "typescript", "go": "go", "rs": "rust", "java": "java", "rb": "ruby", "php": "php", "c": "c", "cpp": "cpp", "cs": "csharp", "kt": "kotlin", "swift": "swift", "html": "html", "css": "css", "sql": "sql", "sh": "shell", "yml": "yaml", "yaml": "yaml", "json": "json", "md": "markdown", "txt": "text"}
NAMED = {"dockerfile": "docker", "makefile": "make", "rakefile": "ruby", "gemfile": "ruby", "jenkinsfile": "groovy", "vagrantfile": "ruby", "procfile": "yaml"}
GENERATED = r"\.(min\.(js|css|mjs)|map|bundle\.js)$|_pb2\.py$"
DOCS = r"\.(md|rst|adoc|txt)$"
TESTS = r"^test_.*|_test\.[a-z]+$|\.(test|spec)\.[a-z]+$"
TEST_FOLDERS = r"(^|/)(tests?|__tests__|spec|fixtures)/"


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def noise(path: Column) -> Column:
    """lockfile, generated, docs or tests, in this order; null for source."""
    name = name_of(path)
    return (
        F.when(name.isin(LOCKFILES), "lockfile").when(name.rlike(GENERATED), "generated").when(name.rlike(DOCS), "docs").when(name.rlike(TESTS) | F.lower(path).rlike(TEST_FOLDERS), "tests")
    )


def language(path: Column) -> Column:
    """By the file's name, then by its extension."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    name = F.lower(name_of(path))
    out = F.when(name.isin(*NAMED), F.element_at(F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair]), name)).when(ext == "", "unknown")
    for k, v in LANGUAGES.items():
        out = out.when(ext == k, v)
    return out.otherwise("unknown")


def endpoint(path: Column) -> Column:
    """A url path, segment by segment: numbers, long hex and named parameters become :param."""
    segments = F.filter(F.split(F.regexp_extract(path, "^[^?#]*", 0), "/"), lambda s: ~s.isin("", ".", ".."))
    plain = lambda s: F.regexp_replace(s, r":\w+|\{\w+\}|\[\w+\]", ":param")
    each = F.transform(segments, lambda s: F.when(s.rlike("^([0-9]+|[0-9a-f]{8,})$"), ":param").otherwise(plain(s)))
    return F.concat(F.lit("/"), F.array_join(each, "/"))
