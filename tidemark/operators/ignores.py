"""What is left out of reports: path patterns, learned folders, and ignore comments with an expiry date."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.findings import FINDINGS_SQL, LINES_SQL, findings, lines
from tidemark.plans.tables import table

# Fixed values.
SOURCE_FOLDERS = ("src", "app", "lib", "pkg", "internal")
MARKER = r"(?i)tidemark[-_:]?ignore\s*:?\s*([\w*-]*[A-Za-z*][\w*-]*)?\s*(\d{4}[-/]\d{2}[-/]\d{2})?"


def glob_regex(pattern: str) -> str:
    """A glob over whole paths: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` inside a name."""
    shapes = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(shapes.get(p) or re.escape(p) for p in re.split(r"(\*\*/|\*\*|\*|\?)", pattern) if p) + "$"


def _is_prefix(pattern: str) -> bool:
    return pattern.endswith("/**") and not re.search(r"[*?]", pattern[:-3])


def longest_match(path: Column, patterns: list[str]) -> Column:
    """The longest pattern that fits the path; folders (``dir/**``) come before all other globs; null if none."""
    out = F.lit(None).cast("string")
    globs, folders = [p for p in patterns if not _is_prefix(p)], [p for p in patterns if _is_prefix(p)]
    for pattern in (*sorted(globs, key=lambda p: (len(p), p)), *sorted(folders, key=lambda p: (len(p), p))):
        fits = path.startswith(pattern[:-2]) | (path == pattern[:-3]) if _is_prefix(pattern) else path.rlike(glob_regex(pattern))
        out = F.when(fits, pattern).otherwise(out)
    return out


def unignored(rows: DataFrame, patterns: list[str], path: str = "file") -> DataFrame:
    """``rows`` whose path no pattern fits."""
    return rows.where(longest_match(F.col(path), patterns).isNull())


def folder(path: Column, depth: int | None = None) -> Column:
    """The folder of a path; with ``depth`` its first folders only."""
    parts = F.split(path, "/")
    n = F.size(parts) - 1 if depth is None else F.least(F.lit(depth), F.size(parts) - 1)
    return F.array_join(F.slice(parts, 1, F.greatest(n, F.lit(0))), "/")


def rejected_folders(verdicts: DataFrame, least: int = 5, share: float = 0.8, guarded_share: float = 0.95) -> DataFrame:
    """Folders where findings (file, rejected) are rejected so often that they are worth a pattern.

    Source folders need ``guarded_share``. confidence grows by 0.05 a rejection, up to 0.95.
    """
    g = verdicts.groupBy(folder(F.col("file")).alias("folder")).agg(F.count_if("rejected").alias("rejected"), F.count(F.lit(1)).alias("total")).where("folder <> ''")
    guarded = F.split("folder", "/")[0].isin(*SOURCE_FOLDERS)
    enough = F.col("rejected") >= F.col("total") * F.when(guarded, guarded_share).otherwise(share)
    kept = g.where((F.col("rejected") >= least) & enough)
    return kept.select(F.concat("folder", F.lit("/**")).alias("pattern"), "rejected", "total", F.round(F.least(F.lit(0.95), 0.5 + 0.05 * F.col("rejected")), 4).alias("confidence"))


def data_folders(files: DataFrame, runs: Column, data: Column, least: int = 4, share: float = 0.9) -> DataFrame:
    """Folders (two levels) of at least ``least`` files (path) with none that ``runs`` and almost all ``data``."""
    g = files.where(F.col("path").contains("/")).groupBy(folder(F.col("path"), 2).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.count_if(runs).alias("_runs"), F.count_if(data).alias("_data"))
    wanted = g.where((F.col("files") >= least) & (F.col("_runs") == 0) & (F.col("_data") >= share * F.col("files")) & ~F.split("folder", "/")[0].isin(*SOURCE_FOLDERS))
    return wanted.select(F.concat("folder", F.lit("/**")).alias("pattern"), "files")


def ignore_comments(rows: DataFrame) -> DataFrame:
    """(file, line, rule, expires) of lines (file, line, body) with an ignore comment; no rule means all."""
    found = rows.where(F.col("body").rlike(MARKER))
    rule, day = F.regexp_extract("body", MARKER, 1), F.replace(F.regexp_extract("body", MARKER, 2), F.lit("/"), F.lit("-"))
    return found.select("file", "line", F.when(rule == "", "*").otherwise(F.lower(rule)).alias("rule"), F.try_to_date(F.nullif(day, F.lit("")), "yyyy-MM-dd").alias("expires"))


def suppress(rows: DataFrame, comments: DataFrame, today: Column, id_cols: tuple[str, ...] = ("file", "line", "type")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept, suppressed, warnings) of findings (file, line, type).

    A comment holds for its own line, the next one, and for the whole file from line 1; for types that contain
    its rule or are contained in it. Expired comments suppress nothing: they are warnings where they would have.
    """
    near = comments.select("file", F.explode(F.array(F.col("line"), F.col("line") + 1)).alias("line"), "rule", "expires")
    keys = [F.col(c) for c in id_cols]
    hit = rows.select(*keys).distinct().join(near, ["file", "line"]).unionByName(rows.select(*keys).distinct().join(comments.where("line = 1").select("file", "rule", "expires"), "file"))
    kind = F.lower("type")
    hit = hit.where((F.col("rule") == "*") | kind.contains(F.col("rule")) | F.col("rule").contains(kind))
    live = hit.where(F.col("expires").isNull() | (F.col("expires") >= today)).select(*id_cols).distinct()
    warnings = hit.where(F.col("expires") < today).select(*id_cols, "rule", "expires").distinct()
    return rows.join(live, list(id_cols), "left_anti"), rows.join(live, list(id_cols), "left_semi"), warnings


# --- registered queries ---------------------------------------------------------------------------

PATTERNS = ["web/**", "web/docs/**", "**/test_*", "**/*.md", "news/src/1*"]


def ignored_paths(spark, sf_dir):
    f = findings(spark, sf_dir).select("file").distinct()
    return f.groupBy(F.coalesce(longest_match(F.col("file"), PATTERNS), F.lit("-")).alias("pattern")).agg(F.count(F.lit(1)).alias("files"))


OWNERS = ["/en/**", "/en/1*/**", "/**/*9", "/fr/*"]


def glob_owners(spark, sf_dir):
    """The owner of a page is the longest pattern that fits its path."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(longest_match(path, OWNERS), F.lit("nobody")).alias("owner"))


def learned_folders(spark, sf_dir):
    f = findings(spark, sf_dir)
    return rejected_folders(f.select("file", (F.col("doc_id") % 10 <= 1).alias("rejected")))


def composition(spark, sf_dir):
    """Documents as files of folders by source and language."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("lang") == "en", ".py").when(F.col("doc_id") % 40 == 0, ".txt").otherwise(".json")
    files = d.select(F.concat_ws("/", "source", F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), ext)).alias("path"))
    return data_folders(files, F.col("path").endswith(".py"), F.col("path").endswith(".json"))


def expired_ignores(spark, sf_dir):
    """Every 5th document has a comment in its header, every 7th in line 2, some of them expired."""
    f = findings(spark, sf_dir).select("doc_id", "file", "line", "type")
    rows = lines(table(spark, sf_dir, "documents"))
    body = F.when((F.col("doc_id") % 5 == 0) & (F.col("line") == 1), F.concat(F.lit("# tidemark-ignore: email "), F.when(F.col("doc_id") % 2 == 0, "2030-01-01").otherwise("2020/01/01"))).when((F.col("doc_id") % 7 == 0) & (F.col("line") == 2), "// tidemark-ignore")
    comments = ignore_comments(rows.select("file", "line", body.alias("body")))
    kept, gone, warned = suppress(f, comments, F.to_date(F.lit("2025-01-01")))
    count = lambda df, state: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select("type", F.lit(state).alias("state"), "n")
    return reduce(lambda a, b: a.unionByName(b), [count(kept, "kept"), count(gone, "suppressed"), count(warned, "expired")])


_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
QUERIES = {
    "ignored_paths": (ignored_paths, f"with {FINDINGS_SQL}, f as (select distinct file from findings) select case when file like 'web/docs/%' then 'web/docs/**' when file like 'web/%' then 'web/**' when file similar to 'news/src/1[^/]*' then 'news/src/1*' when file similar to '(.*/)?test_[^/]*' then '**/test_*' when file like '%.md' then '**/*.md' else '-' end as pattern, count(*) as files from f group by 1"),
    "glob_owners": (glob_owners, f"with p as (select page_id, {_PATH} as path from pages) select page_id, case when starts_with(path, '/en/') or path = '/en' then '/en/**' when regexp_full_match(path, '/en/1[^/]*/.*') then '/en/1*/**' when regexp_full_match(path, '/(.*/)?[^/]*9') then '/**/*9' when regexp_full_match(path, '/fr/[^/]*') then '/fr/*' else 'nobody' end as owner from p"),
    "learned_folders": (learned_folders, f"with {FINDINGS_SQL}, g as (select regexp_replace(file, '/[^/]*$', '') as folder, count(*) filter (doc_id % 10 <= 1) as rejected, count(*) as total from findings group by 1) select folder || '/**' as pattern, rejected, total, round(least(0.95::double, 0.5::double + 0.05::double * rejected), 4) as confidence from g where rejected >= 5 and rejected >= total * case when split_part(folder, '/', 1) in ('src', 'app', 'lib', 'pkg', 'internal') then 0.95::double else 0.8::double end"),
    "data_folders": (composition, "with g as (select source || '/' || coalesce(lang, 'none') as folder, count(*) as files, count(*) filter (lang = 'en') as runs, count(*) filter (lang is distinct from 'en' and doc_id % 40 <> 0) as data from documents where source is not null group by 1) select folder || '/**' as pattern, files from g where files >= 4 and runs = 0 and data >= 0.9::double * files and split_part(folder, '/', 1) not in ('src', 'app', 'lib', 'pkg', 'internal')"),
    "expired_ignores": (expired_ignores, f"with {FINDINGS_SQL}, x as (select *, (doc_id % 5 = 0 and type = 'email' and doc_id % 2 = 0) or (doc_id % 7 = 0 and line in (2, 3) and (select count(*) from lines l where l.doc_id = findings.doc_id) >= 2) as gone, doc_id % 5 = 0 and type = 'email' and doc_id % 2 = 1 as late from findings) select type, case when gone then 'suppressed' else 'kept' end as state, count(*) as n from x group by all union all select type, 'expired', count(distinct (file, line)) from x where late group by type"),
}
