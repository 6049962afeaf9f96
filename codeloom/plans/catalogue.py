"""The reference operators on the test tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import paths as P
from codeloom.operators import graph as G
from codeloom.operators import matching as M


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(kind: str, key: str):
    return F.concat(F.lit(kind + ":"), F.col(key).cast("string"))


def key_rows(spark: SparkSession, d: str) -> DataFrame:
    """The tables' keys as a property graph; an edge comes as often as its row."""
    def edge(table, a, ka, b, kb, kind):
        return read(spark, d, table).select(node(a, ka).alias("src"), node(b, kb).alias("dst"), F.lit(kind).alias("kind"))

    return reduce(
        DataFrame.unionByName,
        [
            edge("orders", "order", "o_orderkey", "customer", "o_custkey", "placed-by"),
            edge("customer", "customer", "c_custkey", "nation", "c_nationkey", "located-in"),
            edge("supplier", "supplier", "s_suppkey", "nation", "s_nationkey", "located-in"),
            edge("nation", "nation", "n_nationkey", "region", "n_regionkey", "belongs-to"),
            edge("lineitem", "order", "l_orderkey", "part", "l_partkey", "contains"),
            edge("lineitem", "part", "l_partkey", "supplier", "l_suppkey", "supplied-by"),
        ],
    )


def key_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.union_edges([key_rows(spark, d)])


EDGES = """edges AS (
  SELECT 'order:' || o_orderkey AS src, 'customer:' || o_custkey AS dst, 'placed-by' AS kind FROM orders
  UNION SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'located-in' FROM customer
  UNION SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located-in' FROM supplier
  UNION SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'belongs-to' FROM nation
  UNION SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'contains' FROM lineitem
  UNION SELECT 'part:' || l_partkey, 'supplier:' || l_suppkey, 'supplied-by' FROM lineitem)"""


def _reach(root: str, depth: int, src: str, dst: str, where: str = "TRUE") -> str:
    return f"""reach(id, depth) AS (SELECT '{root}', 0 UNION SELECT e.{dst}, r.depth + 1 FROM reach r JOIN edges e ON e.{src} = r.id WHERE r.depth < {depth} AND {where}),
seen AS (SELECT id, min(depth) AS depth FROM reach GROUP BY id)"""


def roots(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i,) for i in ids], "id string")


def flat(via: str = "via"):
    return F.array_join(via, ",").alias(via)


Q: dict = {}
O: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = sql
        return f

    return add


@query(f"WITH {EDGES} SELECT * FROM edges")
def edge_dedupe(spark, d):
    return key_edges(spark, d)


@query(f"WITH RECURSIVE {EDGES}, {_reach('order:1', 4, 'src', 'dst')} SELECT id, depth FROM seen WHERE depth > 0")
def deps_bfs(spark, d):
    return G.traverse(key_rows(spark, d), roots(spark, "order:1"), 4).select("id", "depth")


@query(f"WITH RECURSIVE {EDGES}, {_reach('region:0', 3, 'dst', 'src')} SELECT id, depth FROM seen WHERE depth > 0")
def dependents_bfs(spark, d):
    return G.traverse(G.reverse(key_rows(spark, d)), roots(spark, "region:0"), 3).select("id", "depth")


@query(
    f"""WITH RECURSIVE {EDGES}, {_reach('region:1', 3, 'dst', 'src')}
SELECT s.id, s.depth, string_agg(DISTINCT e.kind, ',' ORDER BY e.kind) AS via FROM seen s JOIN edges e ON e.src = s.id JOIN seen p ON p.id = e.dst AND p.depth < 3
WHERE s.depth > 0 GROUP BY s.id, s.depth"""
)
def via_sets(spark, d):
    return G.traverse(G.reverse(key_rows(spark, d)), roots(spark, "region:1"), 3).select("id", "depth", flat())


@query(f"WITH {EDGES} SELECT * FROM edges WHERE kind IN ('located-in', 'belongs-to')")
def relationship_filter(spark, d):
    return G.with_kinds(key_edges(spark, d), ["located-in", "belongs-to"])


@query(f"WITH RECURSIVE {EDGES}, {_reach('region:0', 3, 'dst', 'src')} SELECT split_part(id, ':', 1) AS id, min(depth) AS depth FROM seen WHERE depth > 0 GROUP BY 1")
def folder_collapse(spark, d):
    entries = G.traverse(G.reverse(key_rows(spark, d)), roots(spark, "region:0"), 3)
    return G.collapse(entries, F.substring_index("id", ":", 1)).select("id", "depth")


@query(f"WITH RECURSIVE {EDGES}, {_reach('order:7', 2, 'src', 'dst')} SELECT e.src, e.dst, e.kind, s.depth + 1 AS depth FROM edges e JOIN seen s ON s.id = e.src WHERE s.depth < 3")
def flow_slice(spark, d):
    return G.flow(key_rows(spark, d), roots(spark, "order:7"), 3)


@query(f"WITH RECURSIVE {EDGES}, {_reach('nation:3', 1, 'dst', 'src')} SELECT e.src AS dst, e.dst AS src, e.kind, s.depth + 1 AS level FROM edges e JOIN seen s ON s.id = e.dst WHERE s.depth < 2")
def related_arcs(spark, d):
    return G.related_edges(G.reverse(key_rows(spark, d)), roots(spark, "nation:3"), 2)


@query(
    f"""WITH RECURSIVE {EDGES}, {_reach('order:5', 4, 'src', 'dst')}
SELECT c.id, c.depth, p[1] AS parent, p[2] AS kind FROM (
  SELECT s.id, s.depth, min([e.src, e.kind]) AS p FROM seen s JOIN edges e ON e.dst = s.id JOIN seen u ON u.id = e.src AND u.depth + 1 = s.depth GROUP BY s.id, s.depth) c"""
)
def first_parent(spark, d):
    return G.first_parents(key_rows(spark, d), roots(spark, "order:5"), 4)


@query(
    f"""WITH RECURSIVE {EDGES}, up AS (SELECT * FROM edges WHERE kind IN ('placed-by', 'located-in', 'belongs-to') AND src NOT LIKE 'supplier%'),
walk(id, kinds) AS (SELECT dst, kind FROM up WHERE src = 'order:3' UNION SELECT u.dst, w.kinds || ',' || u.kind FROM walk w JOIN up u ON u.src = w.id)
SELECT id, CASE WHEN kinds LIKE '%belongs-to%' THEN 'low' WHEN kinds LIKE '%located-in%' THEN 'medium' ELSE 'high' END AS confidence FROM walk"""
)
def path_confidence(spark, d):
    up = G.with_kinds(key_rows(spark, d), ["placed-by", "located-in", "belongs-to"])
    paths = G.path_kinds(G.first_parents(up, roots(spark, "order:3")))
    return paths.select("id", G.confidence(F.col("kinds"), ["belongs-to"], ["located-in"]).alias("confidence"))


@query(
    """SELECT l_returnflag AS category, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 2 GROUP BY 1"""
)
def effects_by_category(spark, d):
    up = G.with_kinds(key_rows(spark, d), ["placed-by", "located-in", "belongs-to"]).where("src not like 'supplier:%'")
    reached = G.traverse(G.reverse(up), roots(spark, "region:2"))
    sites = read(spark, d, "lineitem").select(node("order", "l_orderkey").alias("id"), F.col("l_returnflag").alias("category"))
    return sites.join(reached.select("id"), "id", "left_semi").groupBy("category").agg(F.count("*").alias("n"))


@query(
    f"""WITH RECURSIVE {EDGES}, {_reach('region:0', 4, 'dst', 'src', "e.src NOT IN (SELECT 'nation:' || n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")}
SELECT id, depth FROM seen WHERE depth > 0"""
)
def boundary_bfs(spark, d):
    stop = read(spark, d, "nation").where("n_nationkey % 2 = 0").select(node("nation", "n_nationkey").alias("id"))
    return G.visit(G.reverse(key_rows(spark, d)), roots(spark, "region:0"), 4, stop).where("depth > 0")


def _jobs(spark, d, kind):
    return read(spark, d, "events").where(F.col("event_type") == kind).select(F.col("user_id").alias("queue"), F.get_json_object("props", "$.k").cast("bigint").alias("job")).where("job is not null")


JOBS = "SELECT DISTINCT user_id AS queue, CAST(json_extract_string(props, '$.k') AS BIGINT) AS job FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND event_type = "


@query(f"SELECT * FROM ({JOBS} 'signup') INTERSECT SELECT * FROM ({JOBS} 'purchase')")
def queue_match(spark, d):
    return M.matched(_jobs(spark, d, "signup"), _jobs(spark, d, "purchase"), ["queue", "job"])


@query(
    f"""SELECT *, 'producer' AS kind FROM (SELECT * FROM ({JOBS} 'signup') EXCEPT SELECT * FROM ({JOBS} 'purchase'))
UNION ALL SELECT *, 'worker' FROM (SELECT * FROM ({JOBS} 'purchase') EXCEPT SELECT * FROM ({JOBS} 'signup'))"""
)
def queue_unmatched(spark, d):
    return M.unmatched(_jobs(spark, d, "signup"), _jobs(spark, d, "purchase"), ["queue", "job"])


ROUTES = ["/:lang/:id", "/en/**", "/fr/:id"]


@query(
    """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages),
m AS (SELECT page_id, '/:lang/:id' AS pattern, [3, 3] AS _ FROM p WHERE regexp_matches(path, '^/[^/]+/[^/]+/?$')
 UNION ALL SELECT page_id, '/en/**', [3] FROM p WHERE regexp_matches(path, '^/en(/|$)')
 UNION ALL SELECT page_id, '/fr/:id', [3] FROM p WHERE regexp_matches(path, '^/fr/[^/]+/?$'))
SELECT page_id, pattern FROM m"""
)
def route_match(spark, d):
    # segments are bucketed by their number and first literal only where patterns are many; three are a literal table
    pages = read(spark, d, "pages").select("page_id", P.url_path(F.col("url")).alias("path"))
    each = pages.withColumn("pattern", F.explode(F.array(*[F.lit(r) for r in ROUTES])))
    return each.where(P.route_matches(F.col("path"), F.col("pattern"))).select("page_id", "pattern")


@query("""SELECT page_id, pattern FROM (SELECT page_id, CASE WHEN regexp_matches(path, '^/fr/[^/]+/?$') THEN '/fr/:id' WHEN regexp_matches(path, '^/[^/]+/[^/]+/?$') AND NOT regexp_matches(path, '^/en(/|$)') THEN '/:lang/:id' WHEN regexp_matches(path, '^/en(/|$)') THEN '/en/**' END AS pattern
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') AS path FROM pages)) WHERE pattern IS NOT NULL""")
def route_specificity(spark, d):
    w = Window.partitionBy("page_id").orderBy(P.route_specificity(F.col("pattern")).desc(), "pattern")
    return route_match(spark, d).withColumn("_n", F.row_number().over(w)).where("_n = 1").select("page_id", "pattern")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages""")
def page_links(spark, d):
    return read(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'))).alias("link"))


@query(
    """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT link FROM l WHERE link NOT IN (SELECT '/' || p_brand FROM part) AND link NOT IN (SELECT regexp_replace(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '[?#].*$', '') FROM pages)"""
)
def link_reachability(spark, d):
    known = read(spark, d, "part").select(F.concat(F.lit("/"), "p_brand").alias("link")).unionByName(read(spark, d, "pages").select(P.url_path(F.col("url")).alias("link")))
    return page_links(spark, d).select("link").distinct().join(known.distinct(), "link", "left_anti")


@query(
    """SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda kv: split_part(kv, '=', 1)), lambda k: k <> '' AND k <> 'page'))), ',') AS missing
FROM pages WHERE len(list_filter(list_transform(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda kv: split_part(kv, '=', 1)), lambda k: k <> '' AND k <> 'page')) > 0"""
)
def contract_missing_params(spark, d):
    missing = F.array_except(P.query_params(F.col("url")), F.array(F.lit("page")))
    return read(spark, d, "pages").select("page_id", missing.alias("missing")).where(F.size("missing") > 0).select("page_id", flat("missing"))


@query(
    """WITH o AS (SELECT p_brand AS name, list_sort(list(DISTINCT [p_type, CAST(p_size AS VARCHAR)])) AS s FROM part WHERE p_partkey % 3 <> 0 GROUP BY 1),
n AS (SELECT p_brand AS name, list_sort(list(DISTINCT [p_type, CAST(p_size AS VARCHAR)])) AS s FROM part WHERE p_partkey % 3 <> 1 GROUP BY 1)
SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.s IS NULL THEN 'added' WHEN n.s IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.name = n.name WHERE o.s IS DISTINCT FROM n.s"""
)
def lockfile_diff(spark, d):
    part = read(spark, d, "part").select(F.col("p_brand").alias("name"), "p_type", "p_size", "p_partkey")
    return M.snapshot_diff(part.where("p_partkey % 3 <> 0"), part.where("p_partkey % 3 <> 1"), "name", ["p_type", "p_size"])


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def dead_exports(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id")).join(read(spark, d, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("id")), "id", "left_anti")


@query("SELECT p_partkey AS id, count(DISTINCT l_orderkey) AS importers FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1")
def importers_count(spark, d):
    uses = read(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), "l_orderkey")
    return read(spark, d, "part").select(F.col("p_partkey").alias("id")).join(uses, "id", "left").groupBy("id").agg(F.countDistinct("l_orderkey").alias("importers"))


@query("""SELECT p_partkey, p_name, p_type, first_p_partkey FROM (SELECT p_partkey, p_name, p_type, row_number() OVER w AS n, first_value(p_partkey) OVER w AS first_p_partkey FROM part WINDOW w AS (PARTITION BY p_name, p_type ORDER BY p_partkey)) WHERE n > 1""")
def unique_exports(spark, d):
    return M.duplicates(read(spark, d, "part").select("p_partkey", "p_name", "p_type"), ["p_name", "p_type"], ["p_partkey"])


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents GROUP BY text HAVING count(*) > 1)")
def duplicate_selectors(spark, d):
    return M.occurrences_of_repeats(read(spark, d, "documents").select("doc_id", "text"), ["text"]).select("doc_id")


@query("SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE len(string_split(text, chr(10))) > 10")
def max_lines_rule(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("bigint").alias("lines")).where("lines > 10")


EMAIL = "[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+[.][A-Za-z0-9.-]*[A-Za-z])"


@query(f"SELECT DISTINCT doc_id, domain FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{EMAIL}', 1))) AS domain FROM documents) WHERE domain <> 'example.com'")
def email_domain_policy(spark, d):
    return read(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(EMAIL))).alias("domain")).select("doc_id", F.lower("domain").alias("domain")).where("domain <> 'example.com'").distinct()


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '[.]html$') OR regexp_matches(url, '^http://')")
def banned_paths(spark, d):
    return read(spark, d, "pages").select("page_id", "url").where(P.matches_any(F.col("url"), ["**.html", "http://**"]))


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(^|\\n)[A-Z][^\\n]*[.](\\n|$)')")
def required_section(spark, d):
    return read(spark, d, "documents").where(~F.col("text").rlike(r"(^|\n)[A-Z][^\n]*[.](\n|$)")).select("doc_id")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 150000)")
def fk_index_anti(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id")).join(read(spark, d, "orders").where("o_orderstatus = 'O' and o_totalprice > 150000").select(F.col("o_custkey").alias("id")), "id", "left_anti")


@query(
    """WITH p AS (SELECT p_partkey, p_brand, CAST(p_partkey AS VARCHAR) AS w FROM part)
SELECT a.p_partkey, min(b.p_partkey) AS covered_by FROM p a JOIN p b ON a.p_brand = b.p_brand AND length(b.w) > length(a.w) AND starts_with(b.w, a.w) GROUP BY 1"""
)
def prefix_self_join(spark, d):
    rows = read(spark, d, "part").select("p_partkey", "p_brand", F.split(F.col("p_partkey").cast("string"), "").alias("digits"))
    return M.strict_prefixes(rows, ["p_brand"], "digits", "p_partkey")


@query(
    """WITH want(value) AS (VALUES ('click'), ('view'), ('refund')), got AS (SELECT DISTINCT event_type AS value FROM events)
SELECT value, 'missing' AS side FROM want WHERE value NOT IN (SELECT value FROM got) UNION ALL SELECT value, 'extra' FROM got WHERE value NOT IN (SELECT value FROM want)"""
)
def finite_set_equal(spark, d):
    want = spark.createDataFrame([("click",), ("view",), ("refund",)], "value string")
    return M.set_difference(want, read(spark, d, "events").select(F.col("event_type").alias("value")))


@query("SELECT page_id FROM pages WHERE CASE WHEN regexp_matches(url, '[?].*$') THEN FALSE WHEN regexp_matches(url, '/fr/') THEN TRUE WHEN regexp_matches(url, '^https://') THEN TRUE ELSE FALSE END")
def ordered_glob(spark, d):
    return read(spark, d, "pages").where(P.ordered_match(F.col("url"), ["https://**", "**/fr/**", "!**[?]**"])).select("page_id")


@query(
    """WITH p AS (SELECT page_id, ltrim(regexp_replace(url, '^[a-zA-Z]+://[^/?#]*', ''), '/') AS path FROM pages),
o(prefix, owner) AS (VALUES ('', 'root'), ('en/', 'english'), ('fr/', 'french'), ('de/', 'german'))
SELECT page_id, arg_max(owner, length(prefix)) AS owner FROM p JOIN o ON starts_with(path, prefix) GROUP BY 1"""
)
def nearest_ancestor(spark, d):
    owners = spark.createDataFrame([("", "root"), ("en/", "english"), ("fr/", "french"), ("de/", "german")], "prefix string, owner string")
    pages = read(spark, d, "pages").select("page_id", F.ltrim(F.regexp_replace("url", "^[a-zA-Z]+://[^/?#]*", ""), F.lit("/")).alias("path"))
    return M.nearest_ancestor(pages, owners).select("page_id", "owner")


@query("SELECT * FROM (SELECT event_id, (SELECT epoch_us(max(v.ts)) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts < e.ts) AS prior FROM events e WHERE event_type = 'purchase') WHERE prior IS NOT NULL")
def prior_step(spark, d):
    events = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return M.last_before(events, ["user_id"], "ts", F.col("event_type") == "purchase", F.col("event_type") == "view").select("event_id", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', prior)").alias("prior")).where("prior is not null")


@query(
    """WITH c AS (SELECT c_mktsegment AS g, c_custkey AS item, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
k AS (SELECT *, row_number() OVER (ORDER BY g, n) AS a FROM c WHERE n <= CASE g WHEN 'BUILDING' THEN 8 ELSE 20 END)
SELECT g AS "group", item FROM k WHERE a <= 20"""
)
def budget_groups(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_mktsegment").alias("group"), (-F.col("c_acctbal")).alias("ord"), F.col("c_custkey").alias("item"))
    return G.take_in_groups(rows, {"BUILDING": 8, "MACHINERY": 20}, 20).select("group", "item")


@query(None)
def stable_sample(spark, d):
    return M.stable_sample(read(spark, d, "pages").select("page_id", "url"), "url", 20)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT (SELECT CAST(ceil(count(*) * 7.5 / 100) AS BIGINT) FROM customer)")
def limit_percent(spark, d):
    rows = read(spark, d, "customer").select("c_custkey")
    return rows.orderBy("c_custkey").limit(-int(-rows.count() * 7.5 // 100))


@query("SELECT c_mktsegment AS segment, count(*) AS total, count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS covered FROM customer GROUP BY 1")
def coverage_summary(spark, d):
    tested = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(1))
    return read(spark, d, "customer").join(tested, "c_custkey", "left").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("total"), F.count("hit").alias("covered"))


@query(
    """WITH v AS (SELECT n_nationkey, n_regionkey, bool_or(coalesce(s_acctbal < 0, FALSE)) AS value FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT 'nation:' || n_nationkey AS id, value FROM v UNION ALL SELECT 'region:' || r_regionkey, coalesce(bool_or(value), FALSE) FROM region LEFT JOIN v ON n_regionkey = r_regionkey GROUP BY r_regionkey"""
)
def inherited_or(spark, d):
    nation = read(spark, d, "nation")
    own = nation.join(read(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left").groupBy(node("nation", "n_nationkey").alias("id")).agg(F.bool_or(F.coalesce(F.col("s_acctbal") < 0, F.lit(False))).alias("value"))
    values = own.unionByName(read(spark, d, "region").select(node("region", "r_regionkey").alias("id"), F.lit(False).alias("value")))
    return G.inherited_or(values, nation.select(node("region", "n_regionkey").alias("src"), node("nation", "n_nationkey").alias("dst")))


@query(
    """WITH RECURSIVE g AS (SELECT DISTINCT 'n' || (l_partkey % 50) AS src, 'n' || (l_suppkey % 50) AS dst FROM lineitem),
r(a, b) AS (SELECT src, dst FROM g UNION SELECT r.a, g.dst FROM r JOIN g ON r.b = g.src)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a"""
)
def scc_cycles(spark, d):
    part = read(spark, d, "lineitem").select(F.concat(F.lit("n"), (F.col("l_partkey") % 50).cast("string")).alias("src"), F.concat(F.lit("n"), (F.col("l_suppkey") % 50).cast("string")).alias("dst"))
    return G.cycles(part)


@query(None)
def scc_whole(spark, d):
    """scc_cycles on the keys as they are; a recursive closure in SQL is too large for them."""
    return G.cycles(read(spark, d, "lineitem").select(F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("dst")))


@query("SELECT c_custkey AS id, coalesce(max(o_orderpriority), any_value(nullif(c_mktsegment, 'BUILDING')), 'read') AS permission FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def permissions_coalesce(spark, d):
    job = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderpriority").alias("job"))
    return read(spark, d, "customer").join(job, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.coalesce("job", F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("read")).alias("permission"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 90")
def structured_config(spark, d):
    return read(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k")).where("k > 90")


@query("SELECT o_orderstatus AS runner, o_orderpriority AS project, string_agg(DISTINCT CAST(o_custkey AS VARCHAR), ',' ORDER BY CAST(o_custkey AS VARCHAR)) AS files FROM orders GROUP BY 1, 2")
def execution_targets(spark, d):
    return read(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("runner"), F.col("o_orderpriority").alias("project")).agg(F.array_join(F.array_sort(F.collect_set(F.col("o_custkey").cast("string"))), ",").alias("files"))
