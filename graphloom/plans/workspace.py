"""A workspace: documents with their links resolved, and what can be asked of them."""

from __future__ import annotations

import json
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import path_order
from ..functions import paths
from ..operators import checks, config, exports, identity, resolve, sets, traverse, views
from ..sources import corpus, frontmatter, stores
from .checkpoint import stored


class UnknownView(ValueError):
    """A name that no view has: an error, never an empty result."""


class AnchorUnresolved(ValueError):
    """A scope whose anchor is no document of the workspace."""


def dotted(meta, key: str):
    for part in key.split("."):
        if isinstance(meta, list) and part.isdecimal():
            meta = meta[int(part)] if int(part) < len(meta) else None
        else:
            meta = meta.get(part) if isinstance(meta, dict) else None
    return meta


def _below(path, folders: tuple[str, ...]):
    out = F.lit(False)
    for f in folders:
        out = out | path.startswith(f.strip("/") + "/")
    return out


def root_candidates(docs: DataFrame, relations: corpus.Relations | None = None) -> DataFrame:
    """(dir, path, rank): documents that may be a folder's root: with metadata, without a parent, not generated. Of a folder the least rank counts: index, readme, any other."""
    inverse = (relations or corpus.Relations()).inverses.get((relations or corpus.Relations()).spanning)
    ok = docs.where("kind = 'content' AND meta_json IS NOT NULL AND error IS NULL").where(~F.array_contains("present", F.lit(inverse or "")))
    ok = ok.where(F.coalesce(F.get_json_object("meta_json", "$.generated"), F.lit("false")) != "true")
    stem = F.lower(F.regexp_replace(paths.file_name(F.col("path")), r"\.[^.]*$", ""))
    return ok.select("dir", "path", F.when(stem == "index", 0).when(stem == "readme", 1).otherwise(2).alias("rank"))


def root_document(docs: DataFrame, folder: str, relations: corpus.Relations | None = None) -> str | None:
    """The root document of the nearest folder at or above ``folder`` that has one; several of the best rank are an error."""
    up = [folder] if not folder else [folder, *("/".join(folder.split("/")[:i]) for i in range(folder.count("/"), 0, -1)), ""]
    # Two rows a rank suffice, whatever a folder holds.
    found = root_candidates(docs, relations).where(F.col("dir").isin(*up)).groupBy("dir", "rank").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n")).collect()
    for at in up:
        if here := sorted((r["rank"], r["path"], r["n"]) for r in found if r["dir"] == at):
            if here[0][2] > 1:
                raise ValueError(f"{here[0][2]} documents of {at or 'the root'} may be its root")
            return here[0][1]
    return None


class Workspace:
    """Lazy tables of one corpus of (path, content). ``registry`` has (id, path), ``terms`` (field, term, retired). ``parked`` are folders that walks, trees, scans and title lookups
    leave out. With ``discover`` the root document and, from the root's pointers, the registry and the definitions are found in the corpus."""

    def __init__(self, files: DataFrame, root: str = "index.md", relations: corpus.Relations | None = None, registry: DataFrame | None = None, terms: DataFrame | None = None, closed_fields: tuple[str, ...] = (), definitions: dict | None = None, parked: tuple[str, ...] = (), discover: bool = False):
        self.files, self.root, self.parked = files, root, parked
        self.relations = relations or corpus.Relations()
        self._registry, self.terms, self.closed_fields = registry, terms, closed_fields
        if discover:
            self.root = root_document(self.documents, "", self.relations)
            definitions = config.effective(self._config_meta(), definitions)
            if self._registry is None and (at := self.pointer("registry")):
                self._registry = stores.registry(self.documents, at)
        self.definitions = definitions or {}
        self.views = views.views_from(self.definitions.get("views"))
        self.exports = exports.exports_from(self.definitions.get("exports"))

    @property
    def spark(self):
        return self.files.sparkSession

    @cached_property
    def documents(self) -> DataFrame:
        """Each file is read and parsed once; later plans read the stored columns that they need."""
        found = corpus.documents(self.files)
        return stored(found.where(~_below(F.col("path"), self.parked)) if self.parked else found, "documents")

    def document(self, path: str):
        """One document's row; an unknown path and one that can't be read are errors."""
        row = self.documents.where(F.col("path") == path).first()
        if row is None:
            raise FileNotFoundError(path)
        if row["error"]:
            raise ValueError(f"{path}: {row['error']}")
        return row

    def get(self, path: str, key: str):
        """A value of a document's metadata by a dotted key; digits index a sequence. None if there is none."""
        return dotted(json.loads(self.document(path)["meta_json"] or "{}"), key)

    def pointer(self, name: str) -> str | None:
        """The path that the root's first link of a pointer relation leads to; only a path counts."""
        row = self.census_all.where((F.col("source") == self.root) & (F.col("site") == name) & (F.col("ord") == 0) & (F.col("resolution") == "path")).first()
        return row["to_path"] if row else None

    def _config_meta(self) -> dict:
        at = self.pointer("config")
        row = self.documents.where(F.col("path") == at).select("meta_json").first() if at else None
        return json.loads(row["meta_json"]) if row and row["meta_json"] else {}

    @cached_property
    def registry(self) -> DataFrame:
        if self._registry is not None:
            return self._registry
        return self.documents.where("fm_id IS NOT NULL").select(F.col("fm_id").alias("id"), "path")

    @cached_property
    def census_all(self) -> DataFrame:
        """Every link of every document, resolved."""
        return stored(resolve.resolve(corpus.edges(self.documents, self.relations), self.documents, self.registry, resolve.title_index(self.documents.where("title IS NOT NULL OR kind <> 'opaque'")), valid_id=identity.is_valid if self._registry is not None else None), "census")

    @cached_property
    def spanning(self) -> DataFrame:
        found = self.census_all.where(F.col("site") == self.relations.spanning).where("to_path IS NOT NULL")
        return found.select("source", F.coalesce("actual", "to_path").alias("target"), F.col("ord"))

    def _start(self, path: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(path or self.root,)], "path string")

    def tree(self, start: str | None = None, ignore_missing: bool = False) -> DataFrame:
        edges = self.census_all.where(F.col("site") == self.relations.spanning).where("resolution <> 'external'")
        edges = edges.select("source", F.coalesce("to_path", "target_text").alias("target"), "ord")
        found = traverse.tree(edges, self._start(start), self.documents.where("error IS NULL"), ignore_missing)
        bad = self.documents.where("error IS NOT NULL").select("path", F.lit(True).alias("__bad"))
        kind = F.when(F.col("__bad") & (F.col("kind") == "missing"), "unreadable").otherwise(F.col("kind"))
        return found.join(bad, "path", "left").withColumn("kind", kind).drop("__bad")

    @cached_property
    def visited(self) -> DataFrame:
        return stored(traverse.walk(self.spanning, self._start()), "visited")

    @cached_property
    def census(self) -> DataFrame:
        """The links of the documents that the walk from the root visits."""
        return self.census_all.join(self.visited.select(F.col("path").alias("source"), "depth"), "source")

    @cached_property
    def payloads(self) -> DataFrame:
        """(source, field, raw, target, attachment, there): what documents name as their content or manifest, and whether it is a file."""
        rows = None
        for name in corpus.PAYLOADS:
            one = self.documents.select(F.col("path").alias("source"), F.lit(name).alias("field"), F.try_element_at(F.col("links")[name], F.lit(1)).alias("raw"), (F.get_json_object("meta_json", "$.attachment") == "true").alias("marked")).where("raw IS NOT NULL")
            rows = one if rows is None else rows.unionByName(one)
        rows = rows.withColumn("target", paths.resolve(F.col("source"), F.col("raw")))
        opaque = ~paths.extension(F.col("target")).isin(*frontmatter.CONTENT, *frontmatter.WHOLE)
        rows = rows.withColumn("attachment", (F.col("field") == "content") & (F.coalesce("marked", F.lit(False)) | opaque)).drop("marked")
        return stored(rows.join(self.documents.select(F.col("path").alias("target"), F.lit(True).alias("there")), "target", "left").withColumn("there", F.coalesce("there", F.lit(False))), "payloads")

    @cached_property
    def shadowed(self) -> DataFrame:
        """(path, sidecar): readable files that a sidecar named after them claims as its attachment; they are bytes, not documents."""
        claim = self.payloads.where("attachment AND there")
        named = paths.stem(F.col("source")) == F.col("target")
        return claim.where(named & paths.extension(F.col("source")).isin(*frontmatter.WHOLE)).select(F.col("target").alias("path"), F.col("source").alias("sidecar"))

    @cached_property
    def reachable(self) -> DataFrame:
        """(path, dir): the visited documents, the targets of all their links, and their payloads."""
        targets = self.census.where("to_path IS NOT NULL").select(F.coalesce("actual", "to_path").alias("path"))
        found = self.visited.select("path").unionByName(targets).distinct()
        held = self.payloads.join(found.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("target").alias("path"))
        return found.unionByName(held).distinct().join(self.documents.select("path", "dir"), "path")

    @cached_property
    def reachable_documents(self) -> DataFrame:
        """(path, dir): what is reached, without shadowed payloads."""
        return self.reachable.join(self.shadowed.select("path"), "path", "left_anti")

    def children(self, parent: str) -> DataFrame:
        """(path, title, ord): one generation below a document, in declaration order; children that can't be read are left out."""
        found = self.spanning.where(F.col("source") == parent).select(F.col("target").alias("path"), "ord")
        return found.join(self.documents.where("error IS NULL").select("path", "title"), "path").orderBy("ord").select("path", "title", "ord")

    def route(self, text: str, start: str | None = None) -> tuple[list[str], list[str]]:
        """(paths, titles to create) of a route of titles below a document."""
        segments, start = traverse.route_segments(text), start or self.root
        titled = self.spanning.join(self.documents.where("error IS NULL").select(F.col("path").alias("target"), F.col("title_text").alias("title")), "target")
        rows = traverse.route(titled.select("source", F.col("target").alias("path"), "title"), start, segments).where("path IS NOT NULL").orderBy("segment").collect()
        return traverse.planned_route([(r["path"], r["n"]) for r in rows], segments, start)

    def loose_attachments(self, everywhere: bool = False) -> DataFrame:
        """(path): opaque files of reached folders, or of all, that no sidecar claims and no manifest covers."""
        files = self.documents.where("kind = 'opaque'").select("path", "dir")
        if not everywhere:
            files = files.join(self.reachable.select("dir").distinct(), "dir", "left_semi")
        covered = sets.under_prefixes(files, stores.manifests(self.documents).where("error IS NULL").select(F.col("root").alias("prefix")).distinct())
        claimed = self.payloads.where("field = 'content'").select(F.col("target").alias("path"))
        return files.join(covered.select("path"), "path", "left_anti").join(claimed, "path", "left_anti").select("path")

    def backlinks(self, target: str | None = None) -> DataFrame:
        return resolve.backlinks(self.census, None if target is None else F.lit(target)).orderBy("to_path", path_order(F.col("source")), "by_id")

    def _scope(self, under: str | None) -> DataFrame:
        if under is not None and self.documents.where((F.col("path") == under) & F.col("error").isNull()).isEmpty():
            raise AnchorUnresolved(under)
        read = self.documents.where("error IS NULL").select("path")
        edges = self.spanning.join(read.select(F.col("path").alias("target")), "target", "left_semi")
        found = traverse.walk(edges, self._start(under)).join(read, "path", "left_semi")
        return (found if under is None else found.where("depth > 0")).select("path")

    def _selection(self, name: str) -> tuple[DataFrame, views.Grouping]:
        if name not in self.views:
            raise UnknownView(name)
        spec = self.views[name]
        return views.select(self.documents, spec.where, self._scope(spec.under)), spec.grouping

    def view_placements(self, name: str) -> DataFrame:
        """(key, path): a flat row for each group that a document is in; the form for large views."""
        return views.placements(*self._selection(name))

    def view_counts(self, name: str) -> DataFrame:
        """(key, n_documents) of each group."""
        return views.counts(*self._selection(name))

    def view_totals(self, name: str) -> DataFrame:
        """(n_documents, n_placements) of a view."""
        return views.totals(*self._selection(name))

    def view(self, name: str) -> DataFrame:
        """(key, n_documents, paths) of a view; key null holds the ungrouped."""
        return views.group(*self._selection(name))

    def export(self, name: str) -> DataFrame:
        """(path, disposition, declared) of an export over the documents below the root."""
        if name not in self.exports:
            raise UnknownView(name)
        spec = self.exports[name]
        docs = self.documents.join(self._scope(None), "path", "left_semi")
        if spec.view is None:
            return exports.plan(docs, spec).select("path", "disposition", "declared")
        if spec.view not in self.views:
            raise UnknownView(spec.view)
        view = self.views[spec.view]
        chosen = views.select(self.documents, view.where, self._scope(view.under)).select("path", F.lit(True).alias("__in"))
        return exports.plan(docs.join(chosen, "path", "left"), spec, F.col("__in")).select("path", "disposition", "declared")

    @cached_property
    def fixity(self) -> DataFrame:
        """(path, state) of documents with metadata: the recorded hash against the bytes of the content, else of the manifest, else the body."""
        docs = self.documents.where("meta_json IS NOT NULL").select("path", F.try_element_at(F.col("texts")["content_hash"], F.lit(1)).alias("recorded"), F.sha2("body", 256).alias("own"))
        named = self.payloads.groupBy(F.col("source").alias("path")).agg(F.min_by("target", "field").alias("target"))
        wanted = named.join(docs.where("recorded IS NOT NULL").select("path"), "path", "left_semi")
        bytes_of = self.files.select(F.col("path").alias("target"), "content").join(wanted.select("target").distinct(), "target", "left_semi").select("target", F.sha2("content", 256).alias("sha"))
        found = docs.join(wanted.join(bytes_of, "target", "left").select("path", "target", "sha"), "path", "left")
        is_ = F.concat(F.lit("sha256:"), F.when(F.col("target").isNull(), F.col("own")).otherwise(F.col("sha")))
        recorded = F.coalesce("recorded", F.lit(""))
        state = F.when(recorded == "", "unrecorded").when(~recorded.startswith("sha256:"), "unverifiable").when(is_.isNull(), "missing").when(recorded == is_, "intact").otherwise("drifted")
        return found.select("path", state.alias("state"))

    def _store_findings(self, seen: DataFrame, deep: bool) -> list[DataFrame]:
        """Findings of manifests, the config document, the stores and the bin."""
        out = []
        nodes = self.payloads.where("field = 'manifest' AND there").join(seen.select(F.col("path").alias("source")), "source", "left_semi").select(F.col("source").alias("node"), F.col("target").alias("manifest"))
        rows = stores.manifests(self.documents).join(nodes, "manifest")
        out.append(checks.finding(rows.where("error IS NOT NULL"), "manifest_malformed", F.col("node"), F.col("node"), F.col("error")))
        sound = rows.where("error IS NULL")
        there = stores.covered_files(self.documents.select("path", "kind"), sound.select("root")).withColumn("found", F.lit(True))
        both = sound.where("path IS NOT NULL").select("node", "root", "path", "hash").join(there, ["root", "path"], "full_outer")
        of_root = sound.select("root", F.col("node").alias("owner")).distinct()
        drift = both.where("node IS NULL OR found IS NULL").join(of_root, "root").groupBy("owner").agg(F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("node").isNull()).alias("extra"))
        out.append(checks.finding(drift, "manifest_drift", F.col("owner"), F.col("owner"), F.concat_ws(" ", F.col("missing").cast("string"), F.lit("missing,"), F.col("extra").cast("string"), F.lit("extra"))))
        if deep:
            hashed = both.where("found AND hash IS NOT NULL").withColumn("full", F.concat_ws("/", F.nullif("root", F.lit("")), "path"))
            files = self.files.select(F.col("path").alias("full"), "content").join(hashed.select("full"), "full", "left_semi").select("full", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("is"))
            wrong = hashed.where(F.col("hash").startswith("sha256:")).join(files, "full").where("hash <> `is`")
            out.append(checks.finding(wrong, "manifest_mismatch", F.col("full"), F.col("node")))
        at = self.pointer("config")
        if at:
            meta = self._config_meta()
            found = [("config_issue", at, at, f"{i.key}: {i.kind} {i.detail}".strip()) for i in config.diagnose(meta)]
            found += [("config_spec_ahead", at, at, str(n)) for n in [config.spec_ahead(meta)] if n is not None]
            out.append(self.spark.createDataFrame(found, "kind string, subject string, doc string, detail string"))
        pointed = [p for name in ("registry", "recycle_bin") if (p := self.pointer(name))]
        if pointed:
            out.append(checks.finding(stores.fenced_stores(self.documents, pointed), "malformed_store", F.col("path"), F.col("path")))
        if bin_ := self.pointer("recycle_bin"):
            gone = stores.missing_bytes(stores.recycle_records(self.documents, bin_), self.documents)
            out.append(checks.finding(gone, "recycled_bytes_missing", F.lit(bin_), F.lit(bin_), F.concat_ws(", ", F.col("missing"))))
        return out

    def check(self, deep: bool = False) -> DataFrame:
        """(kind, subject, doc, detail): all findings from the root; ``deep`` compares the hashes of manifests too. Filter by subject afterwards, never the walk before."""
        docs, census, name = self.documents, self.census, self.relations.spanning
        inverse_name = self.relations.inverses.get(name)
        out = [checks.link_findings(census)]
        held = self.payloads.join(self.reachable.select(F.col("path").alias("source")), "source", "left_semi")
        out.append(checks.finding(held.where("NOT there"), "broken_link", F.col("source"), F.col("source"), F.col("raw")))
        span = census.where(F.col("site") == name).where("to_path IS NOT NULL").select("source", F.coalesce("actual", "to_path").alias("target"), "ord", "depth")
        again = checks.duplicate_containment(span).unionByName(span.where(F.col("target") == self.root)).distinct()
        out.append(checks.finding(again, "duplicate_containment", F.col("target"), F.col("source")))
        with_meta = docs.where("meta_json IS NOT NULL").select(F.col("path").alias("target"))
        if inverse_name:
            back = self.census_all.where(F.col("site") == inverse_name).where("to_path IS NOT NULL").select("source", F.col("to_path").alias("target"))
            first = span.join(again.select("source", "target"), ["source", "target"], "left_anti").join(with_meta, "target", "left_semi")
            out.append(checks.finding(checks.missing_inverse(first, back), "missing_inverse", F.col("target"), F.col("source")))
            claims = back.select(F.col("source").alias("path"), F.col("target").alias("parent"))
        else:
            claims = self.spark.createDataFrame([], "path string, parent string")
        reached = self.reachable
        island = traverse.islands(claims, reached)
        listed = self.census_all.where(F.col("site") == name).where("to_path IS NOT NULL").select(F.col("to_path").alias("path"), F.col("source").alias("parent"))
        unlisted = claims.join(island, "path", "left_semi").join(listed, ["path", "parent"], "left_anti")
        out.append(checks.finding(unlisted, "missing_containment", F.col("path"), F.col("path"), F.col("parent")))
        orphan = checks.orphans(docs.where("kind = 'content'").select("path", "dir").join(self.shadowed.select("path"), "path", "left_anti"), reached, island)
        out.append(checks.finding(orphan, "orphan", F.col("path"), F.col("path")))
        seen = docs.join(reached.select("path"), "path", "left_semi")
        out.append(checks.finding(seen.where("error IS NOT NULL"), "unreadable", F.col("path"), F.col("path"), F.col("error")))
        if self._registry is not None:
            out.append(checks.id_findings(seen.where("kind <> 'opaque'"), self.registry).select("kind", "subject", "doc", "detail"))
        titles = docs.where("title IS NOT NULL").select("path", "title")
        out.append(checks.finding(checks.stale_labels(census, titles), "stale_label", F.col("source"), F.col("source"), F.col("label")))
        out.append(checks.finding(self.fixity.where("state = 'drifted'").join(reached.select("path"), "path", "left_semi"), "fixity_mismatch", F.col("path"), F.col("path")))
        out += self._store_findings(seen, deep)
        out.append(checks.finding(seen.where("array_contains(present, 'content') AND array_contains(present, 'manifest')"), "manifest_conflict", F.col("path"), F.col("path")))
        if self.terms is not None:
            fields = [r["field"] for r in self.terms.select("field").distinct().collect()]  # the vocabulary's fields, from its configuration
            values = seen.select("path", F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col("links")[f].alias("v")) for f in fields))).alias("x")).select("path", "x.field", F.explode("x.v").alias("value"))
            closed = values.where(F.col("field").isin(*self.closed_fields)) if self.closed_fields else values.limit(0)
            out.append(checks.finding(checks.unknown_terms(closed, self.terms), "unknown_term", F.col("path"), F.col("path"), F.col("value")))
            open_ = values.where(~F.col("field").isin(*self.closed_fields)) if self.closed_fields else values
            out.append(checks.finding(checks.near_miss_terms(open_, self.terms), "term_near_miss", F.col("path"), F.col("path"), F.concat_ws(" -> ", "value", "term")))
        return checks.combine(out)
