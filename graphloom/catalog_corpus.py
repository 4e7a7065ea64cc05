"""Queries that go through the parser and the workspace, on a corpus of files made from the driver's tables, and queries of the remaining operators; with the SQL of the same results."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import query
from .functions import paths, values
from .operators import checks, identity, remedies, resolve, sets, views
from .plans import changes
from .plans.workspace import Workspace, root_candidates
from .sources import stores
from .sources.tables import read

HEAD, FOOT = ";;;\n", "\n;;;\n"
_S = "s AS (SELECT s_suppkey AS k, s_name, s_nationkey AS n, n_name, 'suppliers/' || s_suppkey || '.md' AS path, s_suppkey % 10 <> 0 AS listed FROM supplier JOIN nation ON s_nationkey = n_nationkey)"
_DOCS = f"""{_S}, d AS (SELECT 'index.md' AS path, 'Trade' AS title, 'Trade' AS title_text, '' AS body, 0 AS depth, true AS listed, NULL AS k, NULL AS n
UNION ALL SELECT 'regions/' || r_regionkey || '.md', r_name, r_name, '', 1, true, NULL, NULL FROM region
UNION ALL SELECT 'nations/' || n_nationkey || '.md', n_name, n_name, '', 2, true, NULL, NULL FROM nation
UNION ALL SELECT path, CASE WHEN k % 9 <> 0 THEN s_name END, CASE WHEN k % 9 = 0 THEN k::VARCHAR ELSE s_name END, 'Near [[' || n_name || ']] and [other](../Suppliers/' || k || '.md) in `[[code]]`.', 3, listed, k, n FROM s
UNION ALL SELECT 'assets/' || r_regionkey || '.png.yaml', 'Image ' || r_regionkey, 'Image ' || r_regionkey, '', 2, true, NULL, NULL FROM region
UNION ALL SELECT 'photos.yaml', 'Photos', 'Photos', '', 1, true, NULL, NULL)"""
VIEWS = {"audience": {"group": "audience"}, "third": {"group": "audience", "under": "nations/3.md"}}


def files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): an index of regions, nations and suppliers, images with sidecars, a manifest, and some faults."""
    name = lambda kind, key, up="": F.concat(F.lit(f"{up}{kind}/"), F.col(key).cast("string"), F.lit(".md"))
    doc = lambda body, **meta: F.concat(F.lit(HEAD), F.to_json(F.struct(*(v.alias(k) for k, v in meta.items()))), F.lit(FOOT), body)
    text = lambda p, c: spark.createDataFrame([(p, c)], "path string, content string")
    listed = lambda kind, keys, up="": F.transform(F.sort_array(keys), lambda k: F.concat(F.lit(f"{up}{kind}/"), k.cast("string"), F.lit(".md")))
    region, nation, supplier = (read(spark, sf, t) for t in ("region", "nation", "supplier"))
    k, none = F.col("s_suppkey"), F.lit("")
    out = [
        region.agg(F.collect_list("r_regionkey").alias("keys")).select(F.lit("index.md").alias("path"), doc(none, title=F.lit("Trade"), contents=F.concat(listed("regions", F.col("keys")), F.array(F.lit("broken.md"), F.lit("photos.yaml")))).alias("content")),
        text("broken.md", HEAD + "{bad" + FOOT),
        text("photos.yaml", "title: Photos\npart_of: index.md\nmanifest: photos-manifest.json\n"),
        text("photos-manifest.json", '{"root": "photos", "files": [{"path": "a.jpg", "hash": "sha256:00"}, {"path": "gone.jpg"}]}'),
        *(text(p, p) for p in ("photos/a.jpg", "photos/new.jpg", "assets/loose.png")),
    ]
    below = nation.groupBy("n_regionkey").agg(F.collect_list("n_nationkey").alias("keys"))
    asset = F.concat(F.lit("../assets/"), F.col("r_regionkey").cast("string"), F.lit(".png.yaml"))
    with_nations = region.join(below, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    out.append(with_nations.select(name("regions", "r_regionkey").alias("path"), doc(none, title=F.col("r_name"), part_of=F.lit("../index.md"), contents=F.concat(listed("nations", F.coalesce("keys", F.array().cast("array<int>")), "../"), F.array(asset))).alias("content")))
    image = F.concat(F.lit("png"), F.col("r_regionkey").cast("string"))
    out.append(region.select(F.concat(F.lit("assets/"), F.col("r_regionkey").cast("string"), F.lit(".png")).alias("path"), image.alias("content")))
    sha = F.when(F.col("r_regionkey") % 2 == 0, F.sha2(image, 256)).otherwise("00")
    sidecar = F.format_string("title: Image %d\npart_of: ../regions/%d.md\ncontent: %d.png\nattachment: true\ncontent_hash: sha256:%s\n", "r_regionkey", "r_regionkey", "r_regionkey", sha)
    out.append(region.select(F.concat(F.lit("assets/"), F.col("r_regionkey").cast("string"), F.lit(".png.yaml")).alias("path"), sidecar.alias("content")))
    held = supplier.where(k % 10 != 0).groupBy("s_nationkey").agg(F.collect_list("s_suppkey").alias("keys"))
    out.append(nation.join(held, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(name("nations", "n_nationkey").alias("path"), doc(none, title=F.col("n_name"), part_of=name("regions", "n_regionkey", "../"), contents=listed("suppliers", F.col("keys"), "../")).alias("content")))
    body = F.concat(F.lit("Near [["), F.col("n_name"), F.lit("]] and [other](../Suppliers/"), k.cast("string"), F.lit(".md) in `[[code]]`."))
    meta = {
        "part_of": F.when(k % 7 != 0, name("nations", "s_nationkey", "../")),
        "links": F.when(k % 2 == 0, F.array(F.concat((k + 1).cast("string"), F.lit(".md")))),
        "audience": F.when(k % 2 == 0, F.array(F.lit("public"))).when(k % 6 == 3, F.array(F.lit("staff"), F.lit("public"))),
        "content_hash": F.when(k % 4 == 0, F.concat(F.lit("sha256:"), F.sha2(body, 256))).when(k % 4 == 1, "sha256:00"),
    }
    s = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    for numbered in (False, True):
        title = k.cast("long") if numbered else F.col("s_name")
        out.append(s.where((k % 9 == 0) == numbered).select(name("suppliers", "s_suppkey").alias("path"), doc(body, title=title, **meta).alias("content")))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return found.select("path", F.col("content").cast("binary").alias("content"))


@cache
def _workspace(app: str, spark: SparkSession, sf: str) -> Workspace:
    return Workspace(files(spark, sf), definitions={"views": VIEWS, "exports": {"public": {"gate": {"field": "audience", "value": "public"}, "view": "third"}}})


def workspace(spark: SparkSession, sf: str) -> Workspace:
    """The corpus of a folder of tables, parsed and resolved once a session."""
    return _workspace(spark.sparkContext.applicationId, spark, sf)


@query(
    f"WITH {_DOCS} SELECT path, CASE WHEN path LIKE '%.yaml' THEN 'meta' ELSE 'content' END AS kind, CASE WHEN path LIKE '%.yaml' THEN 'whole' ELSE 'fenced' END AS carrier, title, title_text, body FROM d"
    " UNION ALL SELECT 'photos-manifest.json', 'meta', 'whole', NULL, NULL, '' UNION ALL SELECT 'broken.md', 'content', 'fenced', NULL, NULL, ''"
    " UNION ALL SELECT 'assets/' || r_regionkey || '.png', 'opaque', NULL, NULL, NULL, NULL FROM region UNION ALL SELECT unnest(['photos/a.jpg', 'photos/new.jpg', 'assets/loose.png']), 'opaque', NULL, NULL, NULL, NULL"
)
def corpus_documents(spark, sf):
    return workspace(spark, sf).documents.select("path", "kind", "carrier", "title", "title_text", "body")


@query(
    f"WITH {_S} SELECT 'contents' AS site, 'path' AS resolution, (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM s WHERE listed) + 2 AS n"
    " UNION ALL SELECT 'part_of', 'path', (SELECT count(*) FROM region) * 2 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM s WHERE k % 7 <> 0) + 1"
    " UNION ALL SELECT 'links', CASE WHEN k + 1 IN (SELECT k FROM s) THEN 'path' ELSE 'broken' END, count(*) FROM s WHERE k % 2 = 0 GROUP BY 2"
    " UNION ALL SELECT 'body', unnest(['path', 'case_mismatch']), (SELECT count(*) FROM s)"
)
def corpus_census(spark, sf):
    return workspace(spark, sf).census_all.groupBy("site", "resolution").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_S}, v AS (SELECT * FROM s WHERE listed) SELECT path AS to_path, 'nations/' || n || '.md' AS source, 'contents' AS site, false AS by_id FROM v"
    " UNION ALL SELECT 'nations/' || n || '.md', path, 'part_of', false FROM v WHERE k % 7 <> 0 UNION ALL SELECT 'nations/' || n || '.md', path, 'body', false FROM v UNION ALL SELECT 'Suppliers/' || k || '.md', path, 'body', false FROM v"
    " UNION ALL SELECT 'suppliers/' || (k + 1) || '.md', path, 'links', false FROM v WHERE k % 2 = 0 AND k + 1 IN (SELECT k FROM s)"
)
def corpus_backlinks(spark, sf):
    return workspace(spark, sf).backlinks().where("source LIKE 'suppliers/%' OR to_path LIKE 'suppliers/%'")


@query(f"WITH {_DOCS} SELECT depth, 'doc' AS kind, count(*) AS n FROM d WHERE listed GROUP BY depth UNION ALL SELECT 1, 'unreadable', 1")
def corpus_tree(spark, sf):
    return workspace(spark, sf).tree().groupBy("depth", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH {_DOCS}, v AS (SELECT path FROM d WHERE listed UNION SELECT 'suppliers/' || (k + 1) || '.md' FROM s WHERE listed AND k % 2 = 0 AND k + 1 IN (SELECT k FROM s)"
    " UNION SELECT 'assets/' || r_regionkey || '.png' FROM region UNION SELECT unnest(['broken.md', 'photos-manifest.json'])) SELECT path, regexp_extract(path, '^(.*)/', 1) AS dir FROM v"
)
def corpus_reachable(spark, sf):
    return workspace(spark, sf).reachable


@query(
    f"WITH {_S}, v AS (SELECT * FROM s WHERE listed) SELECT 'broken_link' AS kind, path AS subject FROM v WHERE k % 2 = 0 AND k + 1 NOT IN (SELECT k FROM s) UNION ALL SELECT 'case_mismatch', path FROM v UNION ALL SELECT 'missing_inverse', path FROM v WHERE k % 7 = 0"
    " UNION ALL SELECT CASE WHEN k % 7 = 0 THEN 'orphan' ELSE 'missing_containment' END, path FROM s WHERE NOT listed UNION ALL SELECT 'fixity_mismatch', path FROM v WHERE k % 4 = 1"
    " UNION ALL SELECT 'fixity_mismatch', 'assets/' || r_regionkey || '.png.yaml' FROM region WHERE r_regionkey % 2 = 1 UNION ALL SELECT unnest(['unreadable', 'manifest_drift', 'manifest_mismatch']), unnest(['broken.md', 'photos.yaml', 'photos/a.jpg'])"
)
def corpus_check(spark, sf):
    return workspace(spark, sf).check(deep=True).select("kind", "subject")


_AUDIENCE = f"WITH {_DOCS}, a AS (SELECT path, k, n, CASE WHEN k % 2 = 0 THEN ['public'] WHEN k % 6 = 3 THEN ['staff', 'public'] END AS audience FROM d WHERE listed)"
_PLACED = f"{_AUDIENCE}, p AS (SELECT path, unnest(coalesce(audience, [NULL])) AS key FROM a)"


@query(f"{_PLACED} SELECT key, count(*) AS n_documents, string_agg(path, ',' ORDER BY string_split(path, '/')) AS paths FROM p GROUP BY key")
def corpus_view(spark, sf):
    return workspace(spark, sf).view("audience").withColumn("paths", F.array_join("paths", ","))


@query(f"{_PLACED} SELECT key, path FROM p")
def corpus_view_placements(spark, sf):
    return workspace(spark, sf).view_placements("audience")


@query(f"{_PLACED} SELECT count(DISTINCT path) AS n_documents, count(*) AS n_placements FROM p WHERE path IN (SELECT path FROM a WHERE n = 3)")
def corpus_view_totals(spark, sf):
    return workspace(spark, sf).view_totals("third")


@query(f"{_AUDIENCE} SELECT path, CASE WHEN audience IS NULL THEN 'withheld' WHEN n = 3 THEN 'entry' ELSE 'outside_view' END AS disposition, array_to_string(audience, ',') AS declared FROM a")
def corpus_export(spark, sf):
    return workspace(spark, sf).export("public").withColumn("declared", F.array_join("declared", ","))


@query(
    f"WITH {_DOCS} SELECT path, CASE WHEN k % 4 = 0 THEN 'intact' WHEN k % 4 = 1 THEN 'drifted' WHEN path LIKE 'assets/%' THEN CASE WHEN regexp_extract(path, '([0-9]+)', 1)::INT % 2 = 0 THEN 'intact' ELSE 'drifted' END ELSE 'unrecorded' END AS state"
    " FROM d UNION ALL SELECT 'photos-manifest.json', 'unrecorded'"
)
def corpus_fixity(spark, sf):
    return workspace(spark, sf).fixity


@query(f"WITH {_DOCS} SELECT path, title, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS ord FROM d WHERE n = 3 AND listed")
def corpus_children(spark, sf):
    return workspace(spark, sf).children("nations/3.md")


@query("SELECT 'photos-manifest.json' AS manifest, 'photos' AS root, unnest(['a.jpg', 'gone.jpg']) AS path, unnest(['sha256:00', NULL]) AS hash, NULL::VARCHAR AS error")
def corpus_manifest_rows(spark, sf):
    return stores.manifests(workspace(spark, sf).documents)


@query("SELECT 'assets/loose.png' AS path")
def corpus_loose_attachments(spark, sf):
    return workspace(spark, sf).loose_attachments()


@query("SELECT 'assets/' || r_regionkey || '.png.yaml' AS source, 'content' AS field, 'assets/' || r_regionkey || '.png' AS target, true AS attachment, true AS there FROM region UNION ALL SELECT 'photos.yaml', 'manifest', 'photos-manifest.json', false, true")
def corpus_payloads(spark, sf):
    return workspace(spark, sf).payloads.select("source", "field", "target", "attachment", "there")


@query(f"WITH {_S} SELECT '' AS dir, 'index.md' AS path, 0 AS rank UNION ALL SELECT 'suppliers', path, 2 FROM s WHERE k % 7 = 0")
def corpus_root_candidates(spark, sf):
    return root_candidates(workspace(spark, sf).documents)


@query(
    f"WITH {_S}, v AS (SELECT * FROM s WHERE listed), f AS (SELECT 'missing_inverse' AS kind, 'link' AS offer, 'derived' AS warrant, path AS doc FROM v WHERE k % 7 = 0 UNION ALL SELECT 'missing_containment', 'adopt', 'derived', path FROM s WHERE NOT listed AND k % 7 <> 0"
    " UNION ALL SELECT 'fixity_mismatch', 'restamp', 'judgment', path FROM v WHERE k % 4 = 1 UNION ALL SELECT 'fixity_mismatch', 'restamp', 'judgment', 'assets/' || r_regionkey || '.png.yaml' FROM region WHERE r_regionkey % 2 = 1"
    " UNION ALL SELECT unnest(['manifest_drift', 'manifest_mismatch']), 'regenerate', 'judgment', 'photos.yaml') SELECT kind, offer, warrant, count(*) AS n FROM f GROUP BY ALL"
)
def corpus_remedies(spark, sf):
    return remedies.fixed_offers(workspace(spark, sf).check(deep=True)).groupBy("kind", "offer", "warrant").agg(F.count(F.lit(1)).alias("n"))


# operators over rows of the tables


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%Y-%m') AS month, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def grain_chain(spark, sf):
    chain = views.Grain.parse("day").chain()
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    return read(spark, sf, "orders").select("o_orderkey", *(g.cut(day).alias(g.kind) for g in chain))


@query("SELECT count_if(p_partkey % 5 <> 0) AS listed, count_if(p_partkey % 5 <> 0 AND p_partkey % 7 = 0) AS missing, count_if(p_partkey % 5 = 0 AND p_partkey % 7 <> 0) AS extra, bool_and(p_partkey % 5 = 0 OR p_partkey % 3 <> 0) AS hashed FROM part")
def manifest_status(spark, sf):
    part = read(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"))
    listed = part.where("k % 5 <> 0").select("path", F.when(F.col("k") % 3 != 0, F.lit("sha256:1")).alias("hash"))
    found = part.where("k % 7 <> 0").select("path", F.lit("sha256:1").alias("hash"))
    return sets.manifest_status(sets.manifest_diff(listed, found), listed)


@query("SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS to_path, 'x' || o_custkey AS label FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)")
def stale_labels(spark, sf):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    census = read(spark, sf, "orders").select(name("o", "o_orderkey").alias("source"), name("c", "o_custkey").alias("to_path"), F.when(F.col("o_orderkey") % 3 == 0, name("x", "o_custkey")).when(F.col("o_orderkey") % 3 == 1, name("t", "o_custkey")).alias("label"), F.lit("id").alias("resolution"))
    titles = read(spark, sf, "customer").select(name("c", "c_custkey").alias("path"), name("t", "c_custkey").alias("title"))
    return checks.stale_labels(census, titles).select("source", "to_path", "label")


@query(
    "SELECT o_orderkey AS id, 'w' || (o_custkey % 5) AS workspace, CASE WHEN o_custkey % 5 = 4 THEN 'unknown' WHEN o_custkey % 5 = 3 THEN 'mismatched' WHEN o_orderkey % 2 = 0 THEN 'confirmed' ELSE 'unconfirmed' END AS peer FROM orders"
)
def peer_states(spark, sf):
    orders = read(spark, sf, "orders").select(F.concat(F.lit("w"), (F.col("o_custkey") % 5).cast("string")).alias("workspace"), F.col("o_orderkey").alias("id"))
    known = spark.createDataFrame([(f"w{i}", f"/peers/{i}", "other" if i == 3 else f"w{i}") for i in range(4)], "workspace string, location string, says string")
    return stores.peers(orders, known, orders.where("id % 2 = 0")).select("id", "workspace", "peer")


@query("SELECT 'o' || l_orderkey AS origin, count(DISTINCT l_linenumber) AS n_missing FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1")
def recycled_missing(spark, sf):
    line = read(spark, sf, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("origin"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("bin"), "l_linenumber")
    gone = stores.missing_bytes(line.select("origin", "bin"), line.where("l_linenumber % 2 = 1").select(F.col("bin").alias("path")))
    return gone.select("origin", F.size("missing").cast("long").alias("n_missing"))


@query("SELECT 'p/' || p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN 'under' ELSE 'file' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'fresh' ELSE 'stale' END AS change FROM part WHERE p_partkey % 3 <> 1")
def skip_rule_changes(spark, sf):
    part = read(spark, sf, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("p_partkey") % 2 == 0, "under").otherwise("file").alias("kind"), (F.col("p_partkey") % 3).alias("m"))
    return sets.rule_changes(part.where("m <> 2").drop("m"), part.where("m <> 0").drop("m"))


_ID = "lpad(replace(replace(replace(replace((c_custkey % 1000000)::VARCHAR, '1', 'b'), '3', 'd'), '7', 'k'), '9', 'z'), 6, '0')"
_CHECK = " + ".join(f"{i} * (instr('{identity.ALPHABET}', substr(body, {i}, 1)) - 1)" for i in range(1, identity.BODY + 1))


@query(
    f"WITH b AS (SELECT c_custkey AS k, {_ID} AS body FROM customer), i AS (SELECT k, body || substr('{identity.ALPHABET}', (({_CHECK}) % 29) + 1, 1) AS good FROM b)"
    " SELECT k AS source, CASE WHEN k % 4 = 3 THEN 'malformed_id' WHEN k % 4 = 0 THEN 'id' ELSE 'dangling_id' END AS resolution, CASE WHEN k % 4 = 3 THEN 'u' || good ELSE good END AS id, CASE k % 4 WHEN 1 THEN true WHEN 2 THEN false END AS tombstoned FROM i"
)
def id_resolution(spark, sf):
    k = F.col("c_custkey")
    body = F.lpad(F.translate((k % 1000000).cast("string"), "1379", "bdkz"), 6, "0")
    total = F.expr(" + ".join(f"{i} * (instr('{identity.ALPHABET}', substr(body, {i}, 1)) - 1)" for i in range(1, identity.BODY + 1)))
    rows = read(spark, sf, "customer").select(k.alias("k"), body.alias("body"))
    rows = rows.withColumn("good", F.concat("body", F.substr(F.lit(identity.ALPHABET), (total % 29) + 1, F.lit(1))))
    registry = rows.where("k % 4 < 2").select(F.col("good").alias("id"), F.when(F.col("k") % 4 == 0, F.concat(F.lit("c/"), F.col("k").cast("string"))).alias("path"))
    target = F.concat(F.lit("id:"), F.when(F.col("k") % 4 == 3, F.lit("u")).otherwise(""), F.col("good"))
    edges = rows.select(F.col("k").cast("string").alias("source"), target.alias("target_text"))
    found = resolve.resolve(edges, registry.where("path IS NOT NULL").select("path"), registry, valid_id=identity.is_valid)
    return found.select(F.col("source").cast("long").alias("source"), "resolution", "id", "tombstoned")


@query(
    "SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: w <> ''), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS title, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name || '!'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), ''), 'untitled') AS slug,"
    " upper(substr(lower(replace(p_name, ' ', '_')), 1, 1)) || substr(replace(lower(p_name), ' ', ' '), 2) AS humanized FROM part"
)
def text_functions(spark, sf):
    path = F.concat(F.lit("some.folder/"), F.translate("p_name", " ", "_"), F.lit(".md"))
    return read(spark, sf, "part").select("p_partkey", values.path_to_title(path).alias("title"), values.slug(F.concat("p_name", F.lit("!"))).alias("slug"), values.humanize(F.translate("p_name", " ", "_")).alias("humanized"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'stamp_and_time' ELSE 'stamp' END AS op FROM documents WHERE doc_id % 3 < 2 AND text IS NOT NULL")
def stamp_plan(spark, sf):
    states = read(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 3 == 0, "drifted").when(F.col("doc_id") % 3 == 1, "unrecorded").otherwise("intact").alias("state"))
    return changes.stamps(states).withColumnRenamed("path", "doc_id")


@query(
    "WITH f AS (SELECT 'r' || (s_nationkey % 3) || '/n' || s_nationkey || '/' || CASE WHEN s_suppkey % 50 = 0 THEN 'readme' ELSE s_suppkey::VARCHAR END || '.md' AS path FROM supplier), d AS (SELECT DISTINCT regexp_extract(path, '^(.*)/', 1) AS dir FROM f),"
    " a AS (SELECT dir FROM d UNION SELECT regexp_extract(dir, '^([^/]*)', 1) FROM d UNION SELECT '')"
    " SELECT dir, CASE WHEN dir || '/readme.md' IN (SELECT path FROM f) THEN dir || '/readme.md' WHEN dir = '' THEN 'index.md' ELSE dir || '/index.md' END AS node, dir || '/readme.md' NOT IN (SELECT path FROM f) AS synthesized FROM a"
)
def mirror_nodes(spark, sf):
    name = F.when(F.col("s_suppkey") % 50 == 0, "readme").otherwise(F.col("s_suppkey").cast("string"))
    path = F.concat(F.lit("r"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/n"), F.col("s_nationkey").cast("string"), F.lit("/"), name, F.lit(".md"))
    return changes.mirror(read(spark, sf, "supplier").select(path.alias("path")))


@query(
    "WITH o AS (SELECT DISTINCT 'r' || (s_nationkey % 3) || '/n' || s_nationkey || '/' || s_suppkey || '.md' AS path, s_nationkey AS n FROM supplier)"
    " SELECT path AS doc, 'r' || (n % 3) || '/n' || n || '/index.md' AS detail, -2 AS rank FROM o WHERE n % 2 = 0 UNION ALL SELECT path, 'index.md', 0 FROM o"
)
def adoption_offers(spark, sf):
    home = F.concat(F.lit("r"), (F.col("s_nationkey") % 3).cast("string"), F.lit("/n"), F.col("s_nationkey").cast("string"))
    supplier = read(spark, sf, "supplier")
    orphans = supplier.select(F.concat(home, F.lit("/"), F.col("s_suppkey").cast("string"), F.lit(".md")).alias("path"))
    containers = supplier.where("s_nationkey % 2 = 0").select(F.concat(home, F.lit("/index.md")).alias("path")).distinct().unionByName(spark.createDataFrame([("index.md",)], "path string"))
    return remedies.adoptions(orphans, containers).select("doc", "detail", "rank")


@query(
    "WITH f AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT p_partkey AS k, p_name || 'x' AS wanted FROM part)"
    " SELECT 'x/' || k AS doc, 'retarget' AS offer, wanted || '.md -> x/' || name || '.md' AS detail FROM b JOIN f ON levenshtein(wanted, name) BETWEEN 1 AND 2 UNION ALL SELECT DISTINCT 'x/' || k, 'remove_link', wanted || '.md' FROM b"
)
def retarget_offers(spark, sf):
    part = read(spark, sf, "part")
    broken = part.select(F.concat(F.lit("x/"), F.col("p_partkey").cast("string")).alias("source"), F.concat("p_name", F.lit("x.md")).alias("target_text"))
    there = part.select(F.concat(F.lit("x/"), F.col("p_name"), F.lit(".md")).alias("path")).distinct()
    return remedies.retargets(broken, there).select("doc", "offer", "detail")


@query("SELECT s_suppkey, 'a/' || s_suppkey || '.png.yaml' AS first_sidecar, 4::BIGINT AS n_sidecars, 'a.yaml' AS first_node, 'png' AS extension, 'a/' || s_suppkey AS stem FROM supplier")
def sidecar_names(spark, sf):
    path = F.concat(F.lit("a/"), F.col("s_suppkey").cast("string"), F.lit(".png"))
    names = paths.sidecars(path)
    return read(spark, sf, "supplier").select("s_suppkey", names[0].alias("first_sidecar"), F.size(names).cast("long").alias("n_sidecars"), paths.covering_nodes(path)[0].alias("first_node"), paths.extension(path).alias("extension"), paths.stem(path).alias("stem"))
