"""Joins by nearness, likeness, priority and time, and prioritised matching of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.windows import ENTRIES_SQL, log
from tidemark.plans.tables import table


def nearest(rows: DataFrame, keys: list[str], at: str, id_: str, asks: Column, offers: Column) -> DataFrame:
    """For each row that ``asks`` the nearest row of its keys that ``offers``, the earlier and smaller one at ties.

    One ordered pass in each direction: no pairs of a key's rows are made.
    """
    offer = F.when(offers, F.struct(F.col(at).alias("at"), F.col(id_).alias("id")))
    before = F.max(offer).over(Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
    # The same looking back from the other end: a frame that only grows is never computed anew.
    after = F.min(offer).over(Window.partitionBy(*keys).orderBy(F.desc(at)).rangeBetween(Window.unboundedPreceding, 0))
    seen = rows.withColumns({"_before": before, "_after": after}).where(asks)
    least = rows.where(offers).groupBy(*keys, F.col(at).alias("_at")).agg(F.min(id_).alias("_id"))  # of one moment the smallest id
    gap = F.when(F.col("_after.at").isNull() | (F.col(at) - F.col("_before.at") <= F.col("_after.at") - F.col(at)), F.col("_before.at")).otherwise(F.col("_after.at"))
    return seen.withColumn("_at", gap).join(least, [*keys, "_at"]).select(id_, F.col("_id").alias("nearest"), F.abs(F.col(at) - F.col("_at")).alias("gap"))


def nearest_event(spark, sf_dir):
    """Of each user's errors, the purchase of that user nearest in time (the earlier one at ties)."""
    n = nearest(log(spark, sf_dir), ["user_id"], "us", "event_id", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return n.select("event_id", F.col("nearest").alias("purchase"), F.col("gap").alias("gap_us"))


def asof_purchase(spark, sf_dir):
    """The last purchase of a user at or before each error: one ordered pass, no pairs."""
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = log(spark, sf_dir).withColumn("purchase", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w))
    return e.where("event_type = 'error' and purchase is not null").select("event_id", "purchase")


def banded_matches(spark, sf_dir):
    """Pairs of one user's errors and purchases within an hour, joined on hour buckets, not on all pairs."""
    hour = 3_600_000_000
    e = log(spark, sf_dir)
    left = e.where("event_type = 'error'").select("event_id", "user_id", "us", F.explode(F.array(*[F.floor(F.col("us") / hour) + d for d in (-1, 0, 1)])).alias("h"))
    right = e.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), "user_id", F.col("us").alias("us2"), F.floor(F.col("us") / hour).alias("h"))
    return left.join(right, ["user_id", "h"]).where(f"abs(us - us2) <= {hour}").select("event_id", "purchase")


POPULAR = ["small ring", "red widget", "blue bolt", "large gear"]


def typosquats(spark, sf_dir, edits: int = 2):
    """Names within two edits of a popular one but not equal to any; the nearest, then the first."""
    p = table(spark, sf_dir, "part").select("p_name").distinct()
    popular = F.explode(F.array(*map(F.lit, POPULAR)))
    near = p.where(~F.col("p_name").isin(POPULAR)).select("p_name", popular.alias("popular")).withColumn("edits", F.levenshtein("p_name", "popular", edits)).where("edits >= 0")
    return near.groupBy("p_name").agg(F.min(F.struct("edits", "popular")).alias("m")).select("p_name", F.col("m.popular").alias("popular"), F.col("m.edits").cast("long").alias("edits"))


OWNERS = [("/", "everyone"), ("/en", "english"), ("/de", "german"), ("/fr/1", "french-one"), ("/fr", "french")]


def code_owners(spark, sf_dir):
    """The longest matching prefix of a path names the owner."""
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    owner = F.lit("nobody")
    for prefix, name in sorted(OWNERS, key=lambda o: len(o[0])):
        owner = F.when(F.col("path").startswith(prefix), name).otherwise(owner)
    return pages.select("page_id", owner.alias("owner"))


def orphans(spark, sf_dir):
    """Customers without orders and orders of customers that are not in credit."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    idle = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"))
    half = c.where("c_acctbal >= 0")
    lost = o.join(half, o["o_custkey"] == half["c_custkey"], "left_anti").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key"))
    return idle.unionByName(lost)


def contract_diff(spark, sf_dir):
    """Types and hours used by even and odd users: both, only even, only odd."""
    e = log(spark, sf_dir).select("user_id", "event_type", F.hour("ts").cast("long").alias("hour")).where("value > 60")
    a, b = (e.where(f"user_id % 2 = {k}").select("event_type", "hour").distinct().withColumn(x, F.lit(1)) for k, x in ((0, "a"), (1, "b")))
    both = a.join(b, ["event_type", "hour"], "full_outer")
    return both.select("event_type", "hour", F.when(F.col("a").isNull(), "only odd").when(F.col("b").isNull(), "only even").otherwise("both").alias("state"))


CONTROLS = [("C1", "red blue"), ("C2", "widget bolt gear"), ("C3", "small large"), ("C4", "ring red small")]


def scored_controls(spark, sf_dir):
    """Controls ranked for each name by shared words, through an inverted index; the best two."""
    controls = spark.createDataFrame(CONTROLS, "control string, keywords string")
    index = controls.select("control", F.explode(F.split("keywords", " ")).alias("word"))
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    s = names.select("p_name", F.explode(F.split("p_name", " ")).alias("word")).join(index, "word").groupBy("p_name", "control").agg(F.count(F.lit(1)).alias("score"))
    w = Window.partitionBy("p_name").orderBy(F.desc("score"), "control")
    return s.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 2")


def stream_static(spark, sf_dir):
    """Events by the market segment of the customer behind the user."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return log(spark, sf_dir).join(c, "user_id", "left").groupBy(F.coalesce("c_mktsegment", F.lit("unknown")).alias("segment"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def resolved_imports(spark, sf_dir):
    """Names resolved by the first strategy that knows them: exact, then by first word, then by brand."""
    parts = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.element_at(F.array(F.lit("red widget"), F.lit("blue thing"), F.lit("Brand#4"), F.lit("nothing")), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("name"))
    known = lambda c, n: parts.groupBy(c.alias("k")).agg(F.min("p_partkey").alias("p")).withColumn("priority", F.lit(n))
    index = known(F.col("p_name"), 1).unionByName(known(F.split("p_name", " ")[0], 2)).unionByName(known(F.col("p_brand"), 3))
    want = asked.select("id", "name", F.posexplode(F.array("name", F.split("name", " ")[0], "name")).alias("pos", "k")).withColumn("priority", F.col("pos") + 1)
    hit = want.join(index, ["k", "priority"]).groupBy("id", "name").agg(F.min(F.struct("priority", "p")).alias("m"))
    return hit.select("id", "name", F.col("m.p").alias("part"), F.col("m.priority").cast("long").alias("strategy"))


def _q(body: str) -> str:
    return f"with {ENTRIES_SQL} {body}"


_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
QUERIES = {
    "nearest_event": (nearest_event, _q("select a.event_id, b.event_id as purchase, abs(a.us - b.us) as gap_us from entries a join entries b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'purchase' qualify row_number() over (partition by a.event_id order by abs(a.us - b.us), b.us, b.event_id) = 1")),
    "asof_purchase": (asof_purchase, _q("select a.event_id, b.event_id as purchase from entries a join entries b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'purchase' and (b.us < a.us or b.us = a.us and b.event_id <= a.event_id) qualify row_number() over (partition by a.event_id order by b.us desc, b.event_id desc) = 1")),
    "banded_matches": (banded_matches, _q("select a.event_id, b.event_id as purchase from entries a join entries b on a.user_id = b.user_id and a.event_type = 'error' and b.event_type = 'purchase' and abs(a.us - b.us) <= 3600000000")),
    "typosquats": (typosquats, f"with d as (select distinct p_name from part), n as (select p_name, popular, levenshtein(p_name, popular) as edits from d, (select unnest({POPULAR}) as popular) where p_name not in {tuple(POPULAR)}) select p_name, popular, edits from n where edits <= 2 qualify row_number() over (partition by p_name order by edits, popular) = 1"),
    "code_owners": (code_owners, f"select page_id, case when starts_with({_PATH}, '/fr/1') then 'french-one' when starts_with({_PATH}, '/en') then 'english' when starts_with({_PATH}, '/de') then 'german' when starts_with({_PATH}, '/fr') then 'french' when starts_with({_PATH}, '/') then 'everyone' else 'nobody' end as owner from pages"),
    "orphans": (orphans, "select 'customer' as kind, c_custkey as key from customer where c_custkey not in (select o_custkey from orders) union all select 'order', o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal >= 0)"),
    "contract_diff": (contract_diff, _q(", e as (select user_id, event_type, hour(ts) as hour from entries where value > 60), a as (select distinct event_type, hour from e where user_id % 2 = 0), b as (select distinct event_type, hour from e where user_id % 2 = 1) select coalesce(a.event_type, b.event_type) as event_type, coalesce(a.hour, b.hour) as hour, case when a.hour is null then 'only odd' when b.hour is null then 'only even' else 'both' end as state from a full join b on a.event_type = b.event_type and a.hour = b.hour").replace("events) ,", "events),")),
    "scored_controls": (scored_controls, "with c(control, keywords) as (values ('C1', 'red blue'), ('C2', 'widget bolt gear'), ('C3', 'small large'), ('C4', 'ring red small')), i as (select control, unnest(string_split(keywords, ' ')) as word from c), n as (select p_name, unnest(string_split(p_name, ' ')) as word from (select distinct p_name from part)), s as (select p_name, control, count(*) as score from n join i using (word) group by all) select *, row_number() over (partition by p_name order by score desc, control) as place from s qualify place <= 2"),
    "stream_static": (stream_static, _q("select coalesce(c_mktsegment, 'unknown') as segment, event_type, count(*) as n from entries left join customer on c_custkey = user_id group by all")),
    "resolved_imports": (resolved_imports, "with a as (select s_suppkey as id, ['red widget', 'blue thing', 'Brand#4', 'nothing'][s_suppkey % 4 + 1] as name from supplier), i as (select p_name as k, min(p_partkey) as p, 1 as s from part group by 1 union all select string_split(p_name, ' ')[1], min(p_partkey), 2 from part group by 1 union all select p_brand, min(p_partkey), 3 from part group by 1) select id, name, p as part, s::bigint as strategy from a join i on k = case when s = 2 then string_split(name, ' ')[1] else name end qualify row_number() over (partition by id order by s) = 1"),
}
