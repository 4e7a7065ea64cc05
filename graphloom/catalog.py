"""All queries of the engine's own operators over the driver's tables, with the SQL of the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, values
from .operators import checks, conditions, exports, resolve, sets, traverse, views
from .sources.tables import as_documents, page_links, read, trade_edges

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _documents(spark, sf):
    return as_documents(read(spark, sf, "documents"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), ["lang", "source", "n_chars"])


def _orders(spark, sf):
    return as_documents(read(spark, sf, "orders"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")), ["o_orderstatus", "o_orderpriority", "o_orderdate", "o_totalprice"])


def _parts(spark, sf):
    part = read(spark, sf, "part")
    return as_documents(part, F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), ["p_name", "p_brand"], {"words": F.split("p_name", " ")})


@query("SELECT lang AS key, count(*) AS n_documents FROM documents GROUP BY lang")
def view_by_field(spark: SparkSession, sf: str) -> DataFrame:
    return views.counts(_documents(spark, sf), views.Grouping(("lang",)))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS key, count(DISTINCT o_orderkey) AS n_documents FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> 'P' GROUP BY 1")
def view_month_grain(spark: SparkSession, sf: str) -> DataFrame:
    spec = views.ViewSpec.parse("months", {"group": ["o_orderdate"], "by": "month", "where": {"has": "o_orderstatus", "not": {"equals": {"o_orderstatus": "P"}}}})
    return views.counts(views.select(_orders(spark, sf), spec.where), spec.grouping)


@query("SELECT strftime(o_orderdate, '%Y') AS key, count(*) AS n_documents FROM orders GROUP BY 1")
def view_year_grain(spark, sf):
    return views.counts(_orders(spark, sf), views.Grouping(("o_orderdate",), views.Grain("year")))


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS key, count(*) AS n_documents FROM orders GROUP BY 1")
def view_day_grain(spark, sf):
    return views.counts(_orders(spark, sf), views.Grouping(("o_orderdate",), views.Grain("day")))


@query("SELECT upper(substr(p_name, 1, 2)) AS key, count(*) AS n_documents FROM part GROUP BY 1")
def view_initial_grain(spark, sf):
    return views.counts(_parts(spark, sf), views.Grouping(("p_name",), views.Grain("initial", 2)))


@query(
    "SELECT coalesce('q' || CAST(l.quality AS VARCHAR), d.lang, d.source) AS key, count(DISTINCT d.doc_id) AS n_documents FROM documents d"
    " LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id) GROUP BY 1"
)
def view_chain_fallback(spark, sf):
    labels = read(spark, sf, "labels").groupBy("doc_id").agg(F.concat(F.lit("q"), F.max("quality").cast("string")).alias("grade"))
    docs = read(spark, sf, "documents").select("doc_id", "lang", "source").join(labels, "doc_id", "left")
    docs = as_documents(docs, F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), ["grade", "lang", "source"])
    return views.counts(docs, views.Grouping(("grade", "lang", "source")))


@query("SELECT w AS key, count(DISTINCT p_partkey) AS n_documents FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY 1")
def view_multivalue(spark, sf):
    return views.counts(_parts(spark, sf), views.Grouping(("words",)))


@query(
    "SELECT count(DISTINCT p_partkey) AS n_documents, count(*) AS n_placements FROM (SELECT DISTINCT p_partkey, w FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part))"
)
def view_totals(spark, sf):
    return views.totals(_parts(spark, sf), views.Grouping(("words",)))


@query(
    "SELECT 'part/' || p_partkey AS path, 'has' AS condition FROM part WHERE p_name IS NOT NULL UNION ALL SELECT 'part/' || p_partkey, 'equals' FROM part WHERE list_contains(string_split(p_name, ' '), 'red')"
    " UNION ALL SELECT 'part/' || p_partkey, 'not' FROM part WHERE NOT coalesce(p_brand = 'Brand#2', false) UNION ALL"
    " SELECT 'part/' || p_partkey, 'any' FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR p_brand = 'Brand#2' UNION ALL"
    " SELECT 'part/' || p_partkey, 'all' FROM part WHERE list_contains(string_split(p_name, ' '), 'red') AND p_brand <> 'Brand#2' UNION ALL SELECT 'part/' || p_partkey, 'all of none' FROM part"
)
def where_matrix(spark, sf):
    red, brand = {"equals": {"words": "red"}}, {"equals": {"p_brand": "Brand#2"}}
    cases = {"has": {"has": "p_name"}, "equals": red, "not": {"not": brand}, "any": {"any-of": [red, brand]}, "all": {"all-of": [red, {"not": brand}]}}
    compiled = {k: conditions.parse(v) for k, v in cases.items()} | {"all of none": conditions.AllOf(()), "any of none": conditions.AnyOf(())}
    met = F.array_compact(F.array(*(F.when(c.column(), F.lit(k)) for k, c in compiled.items())))
    return _parts(spark, sf).select("path", F.explode(met).alias("condition"))


@query("SELECT 'order/' || o_orderkey AS path, strftime(o_orderdate, '%Y') || '/' || strftime(o_orderdate, '%Y-%m') AS route FROM orders")
def nest_route(spark, sf):
    found = views.nest_route(_orders(spark, sf), views.Grouping(("o_orderdate",)), views.Grain("month"))
    # Without a filter on the route, which Catalyst would push below the columns that make it and so compute them over and over.
    return found.select("path", F.array_join("route", "/").alias("route"))


_TREE = """WITH RECURSIVE e(source, target) AS (SELECT 'root', 'region/' || r_regionkey FROM region UNION ALL SELECT 'region/' || n_regionkey, 'nation/' || n_nationkey FROM nation
 UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey FROM customer UNION ALL SELECT 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders),
t(path, depth) AS (SELECT '{start}', 0 UNION ALL SELECT e.target, t.depth + 1 FROM t JOIN e ON e.source = t.path)"""


def _start(spark, path):
    return spark.createDataFrame([(path,)], "path string")


@query(_TREE.format(start="root") + " SELECT depth, count(*) AS n_nodes, count(DISTINCT path) AS n_paths FROM t GROUP BY depth")
def tree_depth(spark, sf):
    found = traverse.tree(trade_edges(spark, sf), _start(spark, "root"))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_distinct("path").alias("n_paths"))


@query(_TREE.format(start="region/1") + " SELECT path FROM t WHERE depth > 0")
def scope_subtree(spark, sf):
    return traverse.walk(trade_edges(spark, sf), _start(spark, "region/1")).where("depth > 0").select("path")


@query("SELECT 'order/' || o_orderkey AS path, 'region/' || n_regionkey AS root FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def spanning_root(spark, sf):
    edges = trade_edges(spark, sf).where("source <> 'root'")
    return traverse.spanning_root(edges.select(F.col("target").alias("path"), F.col("source").alias("parent"))).where("path LIKE 'order/%'")


@query(
    "SELECT 0 AS segment, 'region/' || min(r_regionkey) AS path, count(*) AS n FROM region WHERE r_name = 'ASIA' UNION ALL"
    " SELECT 1, 'nation/' || min(n_nationkey), count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND n_name = 'NATION_7' HAVING count(*) > 0"
)
def route_lookup(spark, sf):
    names = read(spark, sf, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("target"), F.col("r_name").alias("title"))
    names = names.unionByName(read(spark, sf, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("target"), F.col("n_name").alias("title")))
    children = trade_edges(spark, sf).join(F.broadcast(names), "target").select("source", F.col("target").alias("path"), "title")
    return traverse.route(children, "root", traverse.route_segments(" ASIA / NATION_7 /"))


@query(
    _TREE.format(start="nation/3")
    + " SELECT path FROM t UNION SELECT 'part/' || l_partkey FROM lineitem JOIN t ON t.path = 'order/' || l_orderkey"
)
def reachable_set(spark, sf):
    overlay = read(spark, sf, "lineitem").select(F.concat(F.lit("order/"), "l_orderkey").alias("source"), F.concat(F.lit("part/"), "l_partkey").alias("target"))
    return traverse.reachable(trade_edges(spark, sf), overlay, _start(spark, "nation/3"))


_HREFS = """h AS (SELECT page_id AS source, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target_text, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord FROM pages)"""


@query(f"WITH {_HREFS} SELECT source, ord, target_text FROM h")
def edges_links(spark, sf):
    return page_links(spark, sf)


def _terms(spark):
    rows = [("priority", "1-URGENT", False), ("priority", "2-HIGH", False), ("priority", "3-MEDIUM", True), ("event", "clicks", False), ("event", "vieu", False), ("event", "purchase", False), ("event", "signups", False), ("event", "err", False)]
    return spark.createDataFrame(rows, "field string, term string, retired boolean")


def _census(spark, sf):
    """Pages' URL paths as files; each page links to its own path, in other case and below a parked prefix, and to a bare name and an id."""
    pages = read(spark, sf, "pages")
    path = F.regexp_replace(paths.split_locator(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?].*$", ""))[0], "/$", "")
    files = pages.select("page_id", path.alias("path"))
    targets = F.array(F.concat(F.lit("/"), "path"), F.concat(F.lit("/"), F.upper("path")), F.concat(F.lit("/gone/"), "path"), F.col("url"), F.concat(F.lit("id:"), F.pmod("page_id", F.lit(7)).cast("string")))
    edges = files.join(pages.select("page_id", "url"), "page_id").select("page_id", F.concat(F.lit("index/"), F.col("page_id").cast("string")).alias("source"), F.posexplode(targets).alias("ord", "target_text"))
    registry = spark.createDataFrame([("1", "index/1"), ("2", None)], "id string, path string")
    return resolve.resolve(edges, files.select("path"), registry)


_CENSUS = """f AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?].*$', ''), '^([^#]+)#.*$', '\\1'), '/$', '') AS path FROM pages),
c AS (SELECT 'index/' || page_id AS source, 0 AS ord, 'path' AS resolution, path AS to_path FROM f
 UNION ALL SELECT 'index/' || f.page_id, 1, CASE WHEN EXISTS (SELECT 1 FROM f g WHERE g.path = upper(f.path)) THEN 'path' WHEN EXISTS (SELECT 1 FROM f g WHERE lower(g.path) = lower(f.path)) THEN 'case_mismatch' ELSE 'broken' END, upper(f.path) FROM f
 UNION ALL SELECT 'index/' || page_id, 2, 'broken', NULL FROM f UNION ALL SELECT 'index/' || page_id, 3, 'external', NULL FROM f
 UNION ALL SELECT 'index/' || page_id, 4, CASE WHEN page_id % 7 = 1 THEN 'id' ELSE 'dangling_id' END, CASE WHEN page_id % 7 = 1 THEN 'index/1' END FROM f)"""


@query(f"WITH {_CENSUS} SELECT source, ord, resolution, to_path FROM c")
def resolve_links(spark, sf):
    return _census(spark, sf).select("source", "ord", "resolution", "to_path")


@query(f"WITH {_CENSUS} SELECT to_path, count(*) AS n_links, count(DISTINCT source) AS n_sources FROM c WHERE to_path IS NOT NULL GROUP BY to_path")
def backlinks(spark, sf):
    return resolve.inbound(_census(spark, sf).withColumn("site", F.lit("links")))


@query(f"WITH {_CENSUS} SELECT CASE resolution WHEN 'broken' THEN 'broken_link' ELSE resolution END AS kind, count(*) AS n FROM c WHERE resolution IN ('broken', 'case_mismatch', 'dangling_id') GROUP BY 1")
def link_findings(spark, sf):
    return checks.link_findings(_census(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'customer/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphans(spark, sf):
    files = read(spark, sf, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("path"), F.lit("customer").alias("dir"))
    reached = read(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.concat(F.lit("customer/"), "o_custkey").alias("path"), F.lit("customer").alias("dir")).distinct()
    return checks.orphans(files, reached).select("path")


@query("SELECT o_custkey AS source, o_orderkey AS target FROM orders WHERE o_orderkey % 10 = 3")
def missing_inverse(spark, sf):
    orders = read(spark, sf, "orders")
    spanning = orders.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target"))
    inverse = orders.where("o_orderkey % 10 <> 3").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target"))
    return checks.missing_inverse(spanning, inverse)


@query("SELECT l_partkey AS target, count(*) - 1 AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) > 1")
def duplicate_containment(spark, sf):
    edges = read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct().withColumns({"depth": F.lit(1), "ord": F.lit(0)})
    return checks.duplicate_containment(edges).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


def _values(spark, sf, table, key, field, column):
    return read(spark, sf, table).select(F.col(key).alias("path"), F.lit(field).alias("field"), F.col(column).alias("value"))


@query("SELECT o_orderkey AS path, 'priority' AS field, o_orderpriority AS value, o_orderpriority = '3-MEDIUM' AS retired FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def unknown_term(spark, sf):
    return checks.unknown_terms(_values(spark, sf, "orders", "o_orderkey", "priority", "o_orderpriority"), _terms(spark))


@query(
    "WITH t(term) AS (VALUES ('clicks'), ('vieu'), ('purchase'), ('signups'), ('err')), v AS (SELECT DISTINCT event_type AS value FROM events WHERE event_type NOT IN (SELECT term FROM t)),"
    " d AS (SELECT value, term, levenshtein(value, term) AS distance, row_number() OVER (PARTITION BY value ORDER BY levenshtein(value, term), term) AS r FROM v, t WHERE levenshtein(value, term) BETWEEN 1 AND 2)"
    " SELECT event_id AS path, 'event' AS field, d.value, d.term, d.distance FROM events JOIN d ON d.value = event_type WHERE r = 1"
)
def term_near_miss(spark, sf):
    return checks.near_miss_terms(_values(spark, sf, "events", "event_id", "event", "event_type"), _terms(spark))


@query("SELECT p_name AS name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def alias_ambiguity(spark, sf):
    docs = read(spark, sf, "part").select(F.concat(F.lit("part/"), "p_partkey", F.lit(".md")).alias("path"), F.col("p_name").alias("title"))
    return resolve.title_index(docs).where(F.size("paths") > 1).select("name", F.size("paths").cast("long").alias("n"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def fixity_digest(spark, sf):
    return read(spark, sf, "documents").select("doc_id", values.digest(F.col("text")).alias("digest"))


@query("SELECT 'sha256:' || sha256(text) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def fixity_duplicates(spark, sf):
    return read(spark, sf, "documents").groupBy(values.digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query("SELECT doc_id AS path, CASE doc_id % 4 WHEN 0 THEN 'unrecorded' WHEN 1 THEN 'unverifiable' WHEN 2 THEN 'intact' ELSE 'drifted' END AS state FROM documents")
def fixity_states(spark, sf):
    kind = F.col("doc_id") % 4
    recorded = F.when(kind == 1, "md5:00").when(kind == 2, values.digest(F.col("text"))).when(kind == 3, values.digest(F.concat("text", F.lit("!"))))
    return checks.fixity(read(spark, sf, "documents").select(F.col("doc_id").alias("path"), recorded.alias("recorded"), F.col("text").alias("content"))).select("path", "state")


@query("SELECT 'doc/' || doc_id AS path, CASE WHEN lang <> 'en' THEN 'withheld' WHEN source = 'src1' THEN 'entry' ELSE 'outside_view' END AS disposition FROM documents")
def export_plan(spark, sf):
    spec = exports.ExportSpec.parse("english", {"gate": {"field": "lang", "value": " en "}, "view": "one"})
    return exports.plan(_documents(spark, sf), spec, conditions.Equals("source", "src1").column()).select("path", "disposition")


@query(
    "SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN 'extra' WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'same' END AS status FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 5 = 0)"
)
def manifest_diff(spark, sf):
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("path"), values.digest(F.col("text")).alias("hash"))
    listed = docs.where("path % 3 <> 0").withColumn("hash", F.when(F.col("path") % 7 == 0, F.lit("sha256:0")).otherwise(F.col("hash")))
    return sets.manifest_diff(listed, docs.where("path % 5 <> 0"))


@query(
    "SELECT 'unknown_term' AS kind, o_orderkey AS subject, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'pre_existing' WHEN o_orderkey % 2 = 0 THEN 'fixed' ELSE 'introduced' END AS change"
    " FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"
)
def check_diff(spark, sf):
    found = read(spark, sf, "orders").select(F.lit("unknown_term").alias("kind"), F.col("o_orderkey").alias("subject"))
    return sets.check_diff(found.where("subject % 2 = 0"), found.where("subject % 3 = 0"))


@query(
    "WITH r AS (SELECT 'id' || (c_custkey // 2) AS id, c_custkey AS path FROM customer WHERE c_custkey % 4 = 0) SELECT 'id' || (c_custkey // 3) AS id, c_custkey AS path,"
    " CASE WHEN a.path <> c_custkey THEN 'id_taken' WHEN b.id <> 'id' || (c_custkey // 3) THEN 'path_taken' END AS conflict FROM customer LEFT JOIN r a ON a.id = 'id' || (c_custkey // 3) LEFT JOIN r b ON b.path = c_custkey"
)
def registry_conflicts(spark, sf):
    customer = read(spark, sf, "customer")
    name = lambda n: F.concat(F.lit("id"), F.floor(F.col("c_custkey") / n).cast("string"))
    registry = customer.where("c_custkey % 4 = 0").select(name(2).alias("id"), F.col("c_custkey").alias("path"))
    return checks.conflicts(customer.select(name(3).alias("id"), F.col("c_custkey").alias("path")), registry)


@query(
    "WITH d AS (SELECT c_custkey AS path, CASE WHEN c_custkey % 5 < 3 THEN 'k' || c_custkey END AS fm_id FROM customer), r AS (SELECT 'k' || (CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1000000 ELSE c_custkey END) AS id, c_custkey AS path FROM customer WHERE c_custkey % 5 <> 1)"
    " SELECT CASE c_custkey % 5 WHEN 0 THEN 'id_mismatch' WHEN 1 THEN 'unregistered_id' ELSE 'unstamped_id' END AS kind, c_custkey AS subject FROM customer WHERE c_custkey % 5 IN (0, 1, 3, 4)"
)
def id_findings(spark, sf):
    key, n = F.col("c_custkey"), F.col("c_custkey") % 5
    customer = read(spark, sf, "customer")
    docs = customer.select(key.alias("path"), F.when(n < 3, F.concat(F.lit("k"), key.cast("string"))).alias("fm_id"))
    registry = customer.where(n != 1).select(F.concat(F.lit("k"), F.when(n == 0, key + 1000000).otherwise(key).cast("string")).alias("id"), key.alias("path"))
    return checks.id_findings(docs, registry).select("kind", "subject")


_URLS = "u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"


def _url_paths(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"))


@query(f"WITH {_URLS}, p AS (SELECT DISTINCT regexp_extract(path, '^([^/]+/[a-z]+)/', 1) AS prefix FROM u WHERE path LIKE '%/de/%') SELECT DISTINCT path FROM u JOIN p ON u.path = prefix OR starts_with(u.path, prefix || '/')")
def prefix_parked(spark, sf):
    urls = _url_paths(spark, sf).select("path")
    prefixes = urls.where("path LIKE '%/de/%'").select(F.regexp_extract("path", "^([^/]+/[a-z]+)/", 1).alias("prefix"))
    return sets.under_prefixes(urls, prefixes)


_FOLDS = f"""WITH {_URLS}, files AS (SELECT path, bool_or(page_id % 11 = 0) AS reached, bool_or(page_id % 13 = 0) AS tracked FROM u GROUP BY path),
a AS (SELECT path, reached, tracked, array_to_string(string_split(path, '/')[1:i], '/') AS folder FROM files, LATERAL (SELECT unnest(range(1, len(string_split(path, '/')))) AS i)),
closed AS (SELECT folder FROM a GROUP BY folder HAVING NOT bool_or(reached) AND NOT bool_or(tracked)),
tops AS (SELECT folder FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed d WHERE starts_with(c.folder, d.folder || '/')))
SELECT folder AS path, 'under' AS kind FROM tops UNION ALL
SELECT path, 'file' FROM files f WHERE NOT reached AND NOT tracked AND NOT EXISTS (SELECT 1 FROM tops WHERE starts_with(f.path, folder || '/') OR f.path = folder)"""


@query(_FOLDS)
def skiplist_collapse(spark, sf):
    files = _url_paths(spark, sf).groupBy("path").agg(F.bool_or(F.col("page_id") % 11 == 0).alias("reached"), F.bool_or(F.col("page_id") % 13 == 0).alias("tracked"))
    return sets.skip_rules(files)


@query(
    "WITH g AS (SELECT doc_id % 3 = 0 AS reached, 'doc/' || doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN 'doc/' || (doc_id - 1) ELSE 'doc/' || (doc_id + 5) END AS parent FROM documents)"
    " SELECT path FROM g WHERE NOT reached AND (parent IN (SELECT path FROM g WHERE reached) OR parent IN (SELECT path FROM g WHERE parent IN (SELECT path FROM g WHERE reached)))"
)
def island_closure(spark, sf):
    n = F.col("doc_id")
    name = lambda c: F.concat(F.lit("doc/"), c.cast("string"))
    docs = read(spark, sf, "documents").select(name(n).alias("path"), F.when(n % 3 == 1, name(n - 1)).when(n % 3 == 2, name(n + 5)).alias("parent"), (n % 3 == 0).alias("reached"))
    return traverse.islands(docs.where("NOT reached").select("path", "parent"), docs.where("reached").select("path"))


from . import catalog_corpus  # noqa: E402, F401  its queries register themselves
