"""Imports resolved to files of a tree, and files that nothing imports.

An import gives candidate places in order of the strategies: alias, relative, path, ``::``, dotted with the longest
prefix first, bare name. A file answers to several keys: its path, the path without extension, its folder if it stands for
one (package, module or a file named like it), and each of them without a source root. So all of it is one equi-join
on keys, and the least (candidate, key kind) wins: no import meets all files.

Defined cases: quotes and angle brackets around a module go; null and empty modules and such that name no file
have no row; a file importing itself is no edge. Of files that answer equally well, one of the importer's own kind
comes first, then the smaller path. ``..`` goes up one folder for each further dot or ``../``, at most to the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
ALIASES = {"@/": ("src/", "app/src/", ""), "~/": ("src/", "app/src/", "")}
SOURCE_ROOTS = ("src/main/java/", "src/test/java/", "src/main/kotlin/", "src/")
RUST_ROOTS = ("crate/", "self/", "super/")
PACKAGE_STEMS = ("__init__", "mod", "index")


def family(path: Column) -> Column:
    """The extension of a path, or what it has in common with others of its kind."""
    e = F.regexp_extract(path, r"\.([^/.]+)$", 1)
    return F.when(e.isin("js", "jsx", "ts", "tsx", "mjs", "cjs", "mts"), "script").when(e.isin("c", "h", "cc", "cpp", "cxx", "hpp"), "c").otherwise(e)


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _join(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _tails(parts: Column, least: int) -> Column:
    """Texts of the last parts of a path, the longest first, from ``least`` parts dropped on."""
    n = F.size(parts)
    return F.when(n > least, F.transform(F.sequence(F.lit(least), n - 1), lambda k: F.array_join(F.slice(parts, k + 1, n - k), "/"))).otherwise(F.array().cast("array<string>"))


def candidates(module: Column, folder: Column) -> Column:
    """Places that a module may mean, the likeliest first, without extensions."""
    m = F.regexp_replace(module, "^[\"'<]+|[\"'>]+$", "")
    none = F.array().cast("array<string>")
    if_ = lambda when, places: F.when(when, places).otherwise(none)

    aliased = F.concat(*[if_(m.startswith(a), F.array(*[F.concat(F.lit(root), m.substr(len(a) + 1, 10_000)) for root in roots])) for a, roots in ALIASES.items()])

    dots = F.length(F.regexp_extract(m, r"^\.*", 0))
    ups = F.when(m.startswith("./") | m.startswith("../"), (F.length(F.regexp_extract(m, r"^(?:\.\.?/)*", 0)) - F.length(F.replace(F.regexp_extract(m, r"^(?:\.\.?/)*", 0), F.lit(".."), F.lit("")))) / 2).otherwise(dots - 1).cast("int")
    rest = F.when(m.startswith("./") | m.startswith("../"), F.regexp_replace(m, r"^(?:\.\.?/)+", "")).otherwise(F.replace(F.regexp_replace(m, r"^\.+", ""), F.lit("."), F.lit("/")))
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    above = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - ups, F.lit(0))), "/")
    relative = if_(m.startswith("."), F.array(F.when(rest == "", F.when(above == "", "__init__").otherwise(above)).otherwise(_join(above, rest))))
    rooted = if_(m.startswith("/"), F.array(F.regexp_replace(m, "^/+", "")))

    def by_path(p: Column) -> Column:
        tails = _tails(F.split(p, "/"), 1)
        return F.concat(F.array(_join(folder, p), p), F.flatten(F.transform(tails, lambda t: F.array(_join(folder, t), t))))

    pathlike = if_(~m.rlike(r"^[./]") & m.contains("/"), by_path(m))
    crate = F.replace(m, F.lit("::"), F.lit("/"))
    rust = if_(m.contains("::"), F.concat(by_path(crate), *[if_(crate.startswith(r), by_path(crate.substr(len(r) + 1, 10_000))) for r in RUST_ROOTS]))
    # A dotted name or, in scripts of Rust, a path to something inside a file: the longest prefix first.
    steps = F.split(F.regexp_replace(m, "::|/", "."), r"\.")
    prefixes = F.transform(F.sequence(F.size(steps), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    dotted = if_(~m.rlike(r"^[./]") & m.contains(".") & ~m.contains("/") & ~m.contains("::"), F.concat(F.array(_join(folder, m), m), prefixes))
    inside = if_(m.contains("::"), F.flatten(F.transform(prefixes, lambda p: F.array(p, F.regexp_replace(p, "^(?:crate|self|super)/", "")))))
    bare = if_(~m.rlike(r"[./:]"), F.array(m, _join(folder, m)))
    found = F.concat(aliased, relative, rooted, pathlike, rust, dotted, inside, bare)
    return F.filter(found, lambda c: c != "")


def keys(files: DataFrame) -> DataFrame:
    """(key, kind, dst): the names that a file (path) answers to, the surest kind first."""
    path = F.col("path")
    bare = F.when(path.rlike(r"[^/]\.[^/.]+$"), F.regexp_replace(path, r"\.[^/.]+$", "")).otherwise(path)
    stem, folder = F.regexp_extract(bare, "[^/]*$", 0), folder_of(path)
    stands_for = F.when(stem.isin(*PACKAGE_STEMS) | (stem == F.regexp_extract(folder, "[^/]*$", 0)), folder)
    named = F.array(F.struct(F.lit(0).alias("kind"), path.alias("key")), F.struct(F.lit(1).alias("kind"), bare.alias("key")), F.struct(F.lit(3).alias("kind"), stands_for.alias("key")))
    out = files.select(path.alias("dst"), F.explode(named).alias("n")).select("dst", "n.kind", "n.key").where("key <> ''")
    shorter = out.where("kind > 0").select("dst", (F.col("kind") + 1).alias("kind"), F.explode(F.array_compact(F.array(*[F.when(F.col("key").startswith(r), F.col("key").substr(len(r) + 1, 10_000)) for r in SOURCE_ROOTS]))).alias("key"))
    return out.unionByName(shorter.where("key <> ''")).groupBy("dst", "key").agg(F.min("kind").alias("kind"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, module, dst) of imports (path, module) that name one of ``files`` (path)."""
    asked = imports.where(F.col("module").isNotNull()).select("path", "module").distinct()
    tried = asked.select("path", "module", F.posexplode(candidates(F.col("module"), folder_of(F.col("path")))).alias("place", "key"))
    hit = tried.join(keys(files), "key").where("dst <> path")
    best = hit.groupBy("path", "module").agg(F.min(F.struct("place", F.when(F.col("kind") == 0, 0).otherwise(1).alias("exact"), (family(F.col("dst")) != family(F.col("path"))).alias("foreign"), "kind", "dst")).alias("m"))
    return best.select("path", "module", F.col("m.dst").alias("dst"))


def import_graph(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Edges (src, dst) between files; imports from outside go."""
    return resolve(imports, files).select(F.col("path").alias("src"), "dst").distinct()


#: Files that are there without being imported.
ENTRY_STEMS = ("main", "app", "index", "setup", "manage", "wsgi", "asgi", "conftest", "__init__", "__main__", "cli", "server")
APART = ("tests", "test", "public", "static", "assets", "docs", "fixtures")
CONFIG_EXTENSIONS = ("json", "yaml", "yml", "toml", "sh", "env", "lock")
CONFIG_PREFIXES = (".", "tsconfig", "vite.config", "vitest.config", "jest.config", "playwright.config", "eslint.config", "tailwind.config", "postcss.config")


def dead_files(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files (path) that nothing imports, but for entries, tests, configuration and what is served."""
    path, name = F.col("path"), F.lower(F.regexp_extract("path", "[^/]*$", 0))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    apart = F.arrays_overlap(F.split(F.lower(folder_of(path)), "/"), F.array(*map(F.lit, APART)))
    config = F.regexp_extract(name, r"\.([^.]+)$", 1).isin(*CONFIG_EXTENSIONS) | F.exists(F.array(*map(F.lit, CONFIG_PREFIXES)), lambda p: name.startswith(p))
    tests = stem.startswith("test_") | stem.endswith("_test") | stem.contains(".spec") | stem.contains(".test") | name.endswith(".d.ts")
    left = files.where(~apart & ~config & ~tests & ~stem.isin(*ENTRY_STEMS)).select("path")
    return left.join(edges.select(F.col("dst").alias("path")), "path", "left_anti")
