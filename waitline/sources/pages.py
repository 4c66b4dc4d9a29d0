"""Raw nested pages to flat entity tables.

A page is one gzipped JSON file listed in a JSON-lines manifest.  Everything is one lazy plan:
manifest joined to page files, hash check, ``from_json``, explode, first-page-wins, then one
projection per entity.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waitline.conf import CAPTURED
from waitline.functions.columns import truthy
from waitline.session import written

MANIFEST_SCHEMA = """
project string, tier int, page_index long, sha256 string, cursor_before string, cursor_after string, pr_count long,
query_version string, has_graphql_errors boolean, bypass boolean, dead_numbers array<long>, fatal_transient string,
rate_limit_cost long, bytes long, _corrupt_record string"""

_ACTOR = "struct<login: string, __typename: string, databaseId: bigint, createdAt: string>"
_TOTAL = "struct<totalCount: bigint>"
_LOGIN = "struct<login: string>"
_COMMENT = (
    "id: string, createdAt: string, publishedAt: string, lastEditedAt: string, authorAssociation: string,"
    f" isMinimized: boolean, minimizedReason: string, bodyText: string, author: {_ACTOR}"
)

# The page format's field names.
NODE_FIELDS = {
    "id": "string", "databaseId": "bigint", "number": "bigint", "url": "string", "createdAt": "string", "publishedAt": "string",
    "updatedAt": "string", "closedAt": "string", "mergedAt": "string", "merged": "boolean", "closed": "boolean", "state": "string",
    "isDraft": "boolean", "title": "string", "body": "string", "baseRefName": "string", "isCrossRepository": "boolean",
    "authorAssociation": "string", "lastEditedAt": "string", "additions": "bigint", "deletions": "bigint", "changedFiles": "bigint",
    "headRefName": "string", "headRepositoryOwner": _LOGIN, "maintainerCanModify": "boolean", "locked": "boolean",
    "activeLockReason": "string", "milestone": "struct<title: string>", "mergeable": "string", "editor": _LOGIN,
    "participants": _TOTAL, "files": _TOTAL, "assignees": _TOTAL, "closingIssuesReferences": _TOTAL, "author": _ACTOR,
    "labels": "struct<totalCount: bigint, nodes: array<struct<name: string>>>",
    "reviews": "struct<totalCount: bigint, nodes: array<struct<id: string, state: string, createdAt: string, submittedAt: string,"
               " publishedAt: string, lastEditedAt: string, authorAssociation: string, bodyText: string,"
               f" comments: {_TOTAL}, author: {_ACTOR}>>>",
    "comments": f"struct<totalCount: bigint, nodes: array<struct<{_COMMENT}>>>",
    "reviewThreads": "struct<totalCount: bigint, nodes: array<struct<id: string, isResolved: boolean, isOutdated: boolean,"
                     f" resolvedBy: {_LOGIN}, comments: struct<totalCount: bigint, nodes: array<struct<{_COMMENT}, draftedAt: string,"
                     " state: string, path: string, originalLine: bigint, replyTo: struct<id: string>>>>>>>",
    "commits": "struct<totalCount: bigint, nodes: array<struct<commit: struct<oid: string, committedDate: string,"
               " authoredDate: string, additions: bigint, deletions: bigint, changedFilesIfAvailable: bigint>>>>",
    "timelineItems": "struct<totalCount: bigint, nodes: array<struct<__typename: string, createdAt: string,"
                     f" actor: {_LOGIN}, label: struct<name: string>, previousTitle: string, currentTitle: string,"
                     " previousRefName: string, currentRefName: string, requestedReviewer: struct<__typename: string, login: string, name: string>>>>",
}


def page_schema(fields: Mapping[str, str]) -> str:
    """Schema of a page text of which only these node fields, or parts of them, are read."""
    node = ", ".join(f"{name}: {kind}" for name, kind in fields.items())
    return f"struct<data: struct<repository: struct<pullRequests: struct<nodes: array<struct<{node}>>>>>>"


PAGE_SCHEMA = page_schema(NODE_FIELDS)

# Project folder, tier and page number in a page's path.
PAGE_PATH = r"/([^/]+)/tier(\d+)/page_(\d+)\.json\.gz$"


# --- manifest -------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest records with a ``torn`` flag for lines that do not parse; blank lines are no records."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", " ".join(MANIFEST_SCHEMA.split()), options).alias("r")).select("r.*")
    return parsed.withColumn("torn", F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def is_giveup() -> Column:
    return F.col("fatal_transient").isNotNull()


def giveups(manifest: DataFrame) -> DataFrame:
    """Give-up records with ``resolved``: some other record of the tier got past the same cursor.

    A null cursor resolves nothing.  The successful cursors are reduced to distinct keys first.
    """
    keys = ["project", "tier", "cursor_before"]
    passed = manifest.where(~is_giveup() & F.col("cursor_before").isNotNull()).select(*keys).distinct()
    return manifest.where(is_giveup()).join(passed.withColumn("_ok", F.lit(True)), keys, "left").withColumn(
        "resolved", F.coalesce("_ok", F.lit(False))).drop("_ok")


def dead_numbers(manifest: DataFrame) -> DataFrame:
    """(project, number) of subjects the source itself cannot serve, from bypass records."""
    return manifest.where(~is_giveup() & truthy("bypass")).select(
        "project", F.explode("dead_numbers").alias("number")).distinct()


def page_records(manifest: DataFrame) -> DataFrame:
    """Records that stand for a usable page: no give-up, no bypass note, no metadata, no errors."""
    return manifest.where(
        ~is_giveup() & ~truthy("bypass") & (F.col("tier") != 0) & ~truthy("has_graphql_errors"))


def error_records(manifest: DataFrame) -> DataFrame:
    """What makes a collection incomplete: unresolved give-ups and pages carrying errors."""
    open_ = giveups(manifest).where(~F.col("resolved")).select(
        "project", "tier", "page_index", F.lit("unresolved give-up").alias("problem"))
    bad = manifest.where(~is_giveup() & ~truthy("bypass") & (F.col("tier") != 0) & truthy("has_graphql_errors")).select(
        "project", "tier", "page_index", F.lit("page with errors").alias("problem"))
    return open_.unionByName(bad)


# --- pages ----------------------------------------------------------------------------------------

#: Places of repeated nodes or pages, a few short columns each, up to which their list is broadcast (some 20 MB).
MOST_REPEATS = 300_000


def small(places: DataFrame) -> DataFrame:
    """A written list of places, to be broadcast unless it turned out too long."""
    return F.broadcast(places) if places.count() <= MOST_REPEATS else places


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """Folders are listed by a few tasks per core meanwhile: Spark's own number is one per folder, up to 10,000."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    held = spark.conf.get(name)
    spark.conf.set(name, min(int(held), 4 * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def read_pages(spark: SparkSession, path: str, pattern: str = PAGE_PATH) -> DataFrame:
    """(project, tier, page_index, value): whole page texts; unreadable files and files that are no page are left out."""
    with few_listing_tasks(spark):
        files = (
            spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
            .option("recursiveFileLookup", "true").text(path, wholetext=True)
        )
    where = F.col("_metadata.file_path")
    part = lambda i: F.regexp_extract(where, pattern, i)
    return files.select(
        F.replace(F.url_decode(part(1)), F.lit("__"), F.lit("/")).alias("project"), part(2).try_cast("int").alias("tier"),
        part(3).try_cast("long").alias("page_index"), "value").where(F.col("page_index").isNotNull())


def page_status(records: DataFrame, pages: DataFrame) -> DataFrame:
    """(project, tier, page_index, status): ok, missing (or unreadable), or hash mismatch.

    Texts are hashed where they are read; only the digests meet the manifest.
    """
    keys = ["project", "tier", "page_index"]
    digests = pages.select(*keys, F.sha2(F.encode("value", "UTF-8"), 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(
        F.col("sha256").isNotNull() & (F.col("sha256") != F.col("actual")), "hash mismatch").otherwise("ok")
    return records.select(*keys, "sha256").join(digests, keys, "left").select(*keys, status.alias("status"))


def good_pages(records: DataFrame, pages: DataFrame) -> DataFrame:
    """Page texts whose digest matches, once per record that lists them.

    Texts are hashed where they are read; only the digests meet the manifest.  Nearly every page is listed once and sound,
    so that the list of all others goes to the texts, which stay where they were read.
    """
    keys = ["project", "tier", "page_index"]
    hashed = pages.dropna(subset=keys).withColumn("_actual", F.coalesce(F.sha2(F.encode("value", "UTF-8"), 256), F.lit("no text")))
    # Written, as it is read twice: texts are read and hashed once.
    digests = written(hashed.select(*keys, "_actual").distinct(), "digests")
    same = F.col("sha256").isNull() | (F.col("sha256") == F.col("_actual"))
    listed = digests.join(records.select(*keys, "sha256"), keys).where(same).groupBy(*keys, "_actual").agg(F.count("*").alias("_times"))
    others = digests.join(listed, [*keys, "_actual"], "left").select(*keys, "_actual", F.coalesce("_times", F.lit(0)).alias("_times")).where("_times <> 1")
    others = small(written(others, "other-pages"))
    times = F.expr("explode(array_repeat(0, cast(coalesce(_times, 1) as int)))")
    return hashed.join(others, [*keys, "_actual"], "left").select(*pages.columns, times.alias("_copy")).drop("_copy")


def page_nodes(pages: DataFrame, fields: Mapping[str, str] = NODE_FIELDS) -> DataFrame:
    """(project, tier, page_index, position, node) of every node with an id.

    ``fields`` are the node fields that are read, all unless given; what is left out is skipped while a text is parsed, so
    that an entry there that is no object does not spoil its page.
    """
    body = F.from_json("value", page_schema({"id": NODE_FIELDS["id"], **fields}))
    nodes = body["data"]["repository"]["pullRequests"]["nodes"]
    return pages.select("project", "tier", "page_index", F.posexplode(nodes).alias("position", "node")).where(
        F.col("node.id").isNotNull())


def first_nodes(nodes: DataFrame) -> DataFrame:
    """One node per (project, tier, id): the earliest page wins; repeats come from resumed collection.

    Only keys are ranked.  Repeats are rare, so that the list of their places, once counted, goes to the nodes; the
    bodies stay where they were read, unless that list is too long to broadcast.
    """
    keys = nodes.select("project", "tier", F.col("node.id").alias("id"), "page_index", "position")
    w = W.partitionBy("project", "tier", "id").orderBy("page_index", "position")
    place = ["project", "tier", "page_index", "position"]
    later = keys.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") > 1).select(*place)
    return nodes.join(small(written(later, "repeats")), place, "left_anti")


# --- flattening -----------------------------------------------------------------------------------


def connection(node: str, key: str) -> tuple[Column, Column]:
    """Non-null entries and total of a nested connection; absent means empty and zero."""
    entries = F.filter(F.coalesce(F.col(f"{node}.{key}.nodes"), F.array()), lambda x: x.isNotNull())
    return entries, F.coalesce(F.col(f"{node}.{key}.totalCount"), F.lit(0))


def total(node: str, key: str) -> Column:
    return F.coalesce(F.col(f"{node}.{key}.totalCount"), F.lit(0))


def actor_columns(actor: str, prefix: str = "actor") -> list[Column]:
    """Flat actor; an absent actor is a deleted account, and then nothing is known about it."""
    a = F.col(actor)
    bot = F.coalesce(a["__typename"] == "Bot", F.lit(False)) | F.coalesce(a["login"].endswith("[bot]"), F.lit(False))
    return [
        a["login"].alias(f"{prefix}_login"), a["__typename"].alias(f"{prefix}_type"),
        a["databaseId"].alias(f"{prefix}_database_id"), a["createdAt"].alias(f"{prefix}_created_at"),
        a.isNull().alias(f"{prefix}_is_deleted"), F.when(a.isNotNull(), bot).alias(f"{prefix}_is_bot"),
    ]


def _base(**fields: str) -> list[Column]:
    return [F.col(f"node.{source}").alias(name) for name, source in fields.items()]


_SHARED = dict(
    id="id", database_id="databaseId", number="number", created_at="createdAt", published_at="publishedAt",
    closed_at="closedAt", merged_at="mergedAt", merged="merged", closed="closed", state="state",
    is_draft_current="isDraft", is_cross="isCrossRepository", association_current="authorAssociation",
)


def _whole(*names: str) -> dict[str, str]:
    return {name: NODE_FIELDS[name] for name in names}


def _entries(entry: str) -> str:
    """A connection of which only its total and a part of its entries are read."""
    return f"struct<totalCount: bigint, nodes: array<struct<{entry}>>>"


#: What an entity reads of a node.  Of entries that are only counted one short field is enough.
HISTORY_FIELDS = _whole(*_SHARED.values(), "author") | dict.fromkeys(("reviews", "comments", "reviewThreads", "commits"), _TOTAL)
SUBJECT_FIELDS = {k: v for k, v in NODE_FIELDS.items() if k != "timelineItems"} | {
    "reviews": _entries("state: string"), "comments": _entries("isMinimized: boolean"),
    "reviewThreads": _entries(f"comments: {_TOTAL}"),
    "commits": _entries("commit: struct<authoredDate: string, additions: bigint, deletions: bigint>")}
#: What ``truncated`` and ``order_violations`` read.
CHECKED_FIELDS = {
    "reviews": _entries("submittedAt: string"), "comments": _entries("createdAt: string"),
    "reviewThreads": _entries(f"comments: {_entries('createdAt: string')}"), "commits": _TOTAL, "labels": _TOTAL,
    "timelineItems": _entries("createdAt: string")}
RESPONSE_FIELDS = _whole("reviews", "reviewThreads", "comments")


def history_rows(nodes: DataFrame) -> DataFrame:
    """Thin all-history rows (tier 1)."""
    return coerce_times(nodes.where(F.col("tier") == 1).select(
        "project", *_base(**_SHARED),
        total("node", "reviews").alias("n_reviews"), total("node", "comments").alias("n_comments"),
        total("node", "reviewThreads").alias("n_threads"), total("node", "commits").alias("n_commits"),
        *actor_columns("node.author")))


def truncated() -> Column:
    """Some stream holds more than a page carries (the timeline's total is not usable for this)."""
    over = F.lit(False)
    for key in ("reviews", "comments", "reviewThreads", "commits", "labels"):
        over = over | (total("node", key) > CAPTURED[key])
    threads, _ = connection("node", "reviewThreads")
    deep = F.exists(threads, lambda t: F.coalesce(t["comments"]["totalCount"], F.lit(0)) > CAPTURED["thread_comments"])
    return over | deep


def subject_rows(nodes: DataFrame) -> DataFrame:
    """Rich in-window rows (tier 2) with the change's size at opening and captured / total counts."""
    commits, n_commits = connection("node", "commits")
    labels, n_labels = connection("node", "labels")
    early = F.filter(commits, lambda c: F.coalesce(c["commit"]["authoredDate"] <= F.col("node.createdAt"), F.lit(False)))
    some = F.size(early) > 0
    part = lambda f: F.when(some, F.aggregate(
        early, F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c["commit"][f], F.lit(0))))
    counts = []
    for key, name in (("reviews", "reviews"), ("comments", "comments"), ("reviewThreads", "threads"), ("commits", "commits")):
        entries, n = connection("node", key)
        counts += [n.alias(f"n_{name}"), F.size(entries).alias(f"n_{name}_captured")]
    return coerce_times(nodes.where(F.col("tier") == 2).select(
        "project", *_base(**_SHARED),
        *_base(url="url", updated_at="updatedAt", title_current="title", body_current="body", base_ref_current="baseRefName",
               additions_final="additions", deletions_final="deletions", changed_files_final="changedFiles",
               head_ref="headRefName", head_owner="headRepositoryOwner.login", maintainer_can_modify="maintainerCanModify",
               locked="locked", lock_reason="activeLockReason", milestone="milestone.title", mergeable_current="mergeable",
               last_edited_at="lastEditedAt", editor_login="editor.login", n_participants="participants.totalCount",
               n_files="files.totalCount", n_assignees="assignees.totalCount", n_closing_issues="closingIssuesReferences.totalCount"),
        F.transform(labels, lambda x: x["name"]).alias("labels_current"), n_labels.alias("n_labels_current"),
        part("additions").alias("additions_at_open"), part("deletions").alias("deletions_at_open"),
        F.when(some, F.size(early)).cast("long").alias("n_commits_at_open"),
        ((n_commits == 1) & ~truncated() & some).alias("diff_is_exact"), *counts, truncated().alias("is_truncated"),
        *actor_columns("node.author")))


def _children(nodes: DataFrame, key: str) -> DataFrame:
    entries, _ = connection("node", key)
    return nodes.where(F.col("tier") == 2).select(
        "project", F.col("node.id").alias("id"), F.posexplode(entries).alias("position", "e"))


def _responder() -> list[Column]:
    a = F.col("e.author")
    return [a["login"].alias("login"), a["__typename"].alias("type")]


def _fields(source: str, names: dict[str, str]) -> list[Column]:
    """Columns by their name here and their path below ``source``."""
    return [F.col(f"{source}.{path}").alias(name) for name, path in names.items()]


def review_rows(nodes: DataFrame) -> DataFrame:
    return coerce_times(_children(nodes, "reviews").select(
        "project", "id", "position", F.lit("reviews").alias("stream"), *_fields("e", {
            "response_id": "id",
            "state": "state",
            "created_at": "createdAt",
            "submitted_at": "submittedAt",
            "published_at": "publishedAt",
            "last_edited_at": "lastEditedAt",
            "association": "authorAssociation",
            "body": "bodyText",
            "n_comments": "comments.totalCount",
        }), *_responder()))


def thread_comment_rows(nodes: DataFrame) -> DataFrame:
    """Two levels: threads, then their comments, with the thread's own attributes."""
    threads = _children(nodes, "reviewThreads").withColumnRenamed("e", "t").withColumnRenamed("position", "thread_position")
    entries, n = connection("t", "comments")
    return coerce_times(threads.select(
        "project", "id", "thread_position", "t", n.alias("thread_n_comments"), F.posexplode(entries).alias("position", "e")
    ).select(
        "project", "id", "thread_position", "position", F.lit("thread_comments").alias("stream"), "thread_n_comments",
        *_fields("t", {
            "thread_id": "id",
            "thread_is_resolved": "isResolved",
            "thread_is_outdated": "isOutdated",
            "thread_resolved_by": "resolvedBy.login",
        }),
        *_fields("e", {
            "response_id": "id",
            "created_at": "createdAt",
            "drafted_at": "draftedAt",
            "published_at": "publishedAt",
            "last_edited_at": "lastEditedAt",
            "state": "state",
            "association": "authorAssociation",
            "is_minimized": "isMinimized",
            "minimized_reason": "minimizedReason",
            "path": "path",
            "original_line": "originalLine",
            "reply_to": "replyTo.id",
            "body": "bodyText",
        }), *_responder()))


def issue_comment_rows(nodes: DataFrame) -> DataFrame:
    return coerce_times(_children(nodes, "comments").select(
        "project", "id", "position", F.lit("issue_comments").alias("stream"), *_fields("e", {
            "response_id": "id",
            "created_at": "createdAt",
            "published_at": "publishedAt",
            "last_edited_at": "lastEditedAt",
            "association": "authorAssociation",
            "is_minimized": "isMinimized",
            "minimized_reason": "minimizedReason",
            "body": "bodyText",
        }), *_responder()))


def response_rows(nodes: DataFrame) -> DataFrame:
    """The three streams as one table, ready for labelling."""
    parts = [review_rows(nodes), thread_comment_rows(nodes), issue_comment_rows(nodes)]
    keep = ["project", "id", "stream", "created_at", "submitted_at", "published_at", "login", "type", "association",
            "is_minimized", "minimized_reason", "body", "state"]
    out = None
    for p in parts:
        p = p.select(*[c for c in keep if c in p.columns])
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return out


def timeline_rows(nodes: DataFrame) -> DataFrame:
    who = F.coalesce("e.requestedReviewer.login", "e.requestedReviewer.name")
    return coerce_times(_children(nodes, "timelineItems").select(
        "project", "id", "position", F.lpad(F.col("position").cast("string"), 6, "0").alias("event_key"), *_fields("e", {
            "event_type": "__typename",
            "created_at": "createdAt",
            "actor": "actor.login",
            "label": "label.name",
            "previous_title": "previousTitle",
            "current_title": "currentTitle",
            "previous_ref": "previousRefName",
            "current_ref": "currentRefName",
            "requested_type": "requestedReviewer.__typename",
        }), who.alias("requested")))


def commit_rows(nodes: DataFrame) -> DataFrame:
    return coerce_times(_children(nodes, "commits").select("project", "id", "position", *_fields("e.commit", {
            "oid": "oid",
            "committed_date": "committedDate",
            "authored_date": "authoredDate",
            "additions": "additions",
            "deletions": "deletions",
            "changed_files": "changedFilesIfAvailable",
        })))


def coerce_times(df: DataFrame) -> DataFrame:
    """Text columns named ``*_at`` or ``*_date`` become UTC timestamps; what does not parse becomes null."""
    kinds = dict(df.dtypes)
    return df.select(*[
        F.try_to_timestamp(F.col(c)).alias(c) if c.endswith(("_at", "_date")) and kinds[c] == "string" else F.col(c)
        for c in df.columns])


def order_violations(nodes: DataFrame) -> DataFrame:
    """(project, id, stream, index, prev, next): first place where a stream is not oldest-first.

    Checked inside each row's arrays; missing times are skipped; every thread is its own stream.
    """
    rich = nodes.where(F.col("tier") == 2)
    times = lambda key, field: F.transform(connection("node", key)[0], lambda x: x[field])
    flat = F.array(
        F.struct(F.lit("reviews_submitted").alias("stream"), times("reviews", "submittedAt").alias("at")),
        F.struct(F.lit("issue_comments").alias("stream"), times("comments", "createdAt").alias("at")),
        F.struct(F.lit("timeline").alias("stream"), times("timelineItems", "createdAt").alias("at")))
    threads = F.transform(connection("node", "reviewThreads")[0], lambda t: F.struct(
        F.lit("thread_comments").alias("stream"),
        F.transform(F.coalesce(t["comments"]["nodes"], F.array()), lambda c: c["createdAt"]).alias("at")))
    each = rich.select("project", F.col("node.id").alias("id"), F.explode(F.concat(flat, threads)).alias("s"))
    seen = each.select("project", "id", "s.stream", F.array_compact("s.at").alias("at"))
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size("at") - 2, F.lit(0))),
        lambda i: F.coalesce(F.get("at", i) > F.get("at", i + 1), F.lit(False)))
    bad = seen.withColumn("index", F.get(places, F.lit(0))).where(F.col("index").isNotNull())
    return bad.select("project", "id", "stream", "index", F.get("at", F.col("index")).alias("prev"), F.get("at", F.col("index") + 1).alias("next"))


def conservation(manifest: DataFrame, status: DataFrame, nodes: DataFrame, first: DataFrame) -> DataFrame:
    """One row of counts that must reconcile, with the failures by name.

    ``nodes`` is read several times: pass a written table.
    ``unique_subjects`` adds both tiers, so an id present in both counts twice.
    """
    torn = F.coalesce(F.col("torn"), F.lit(False)) if "torn" in manifest.columns else F.lit(False)
    sound = manifest.where(~torn)
    one = lambda df, expr: df.agg(expr.alias("v")).scalar()
    facts = status.agg(
        F.count_if(F.col("status") == "ok").alias("pages_read"),
        F.count_if(F.col("status") != "ok").alias("pages_bad"),
    ).withColumn("rows_seen", one(nodes, F.count(F.lit(1)))
    ).withColumn("unique_subjects", one(first, F.count(F.lit(1)))
    ).withColumn("truncated_subjects", one(first.where(F.col("tier") == 2), F.count_if(truncated()))
    ).withColumn("dead_subjects", one(dead_numbers(sound), F.count(F.lit(1)))
    ).withColumn("query_versions", one(page_records(sound), F.count_distinct("query_version"))
    ).withColumn("error_pages", one(error_records(sound), F.count(F.lit(1)))
    ).withColumn("order_violations", one(order_violations(first), F.count(F.lit(1))))
    failures = F.array_compact(F.array(
        F.when(F.col("pages_bad") > 0, "unreadable or altered pages"), F.when(F.col("error_pages") > 0, "error pages"),
        F.when(F.col("order_violations") > 0, "order violations"), F.when(F.col("query_versions") > 1, "mixed query versions")))
    return facts.withColumn("duplicate_rows", F.col("rows_seen") - F.col("unique_subjects")).withColumn("failures", failures)


def require_sound(report: DataFrame) -> None:
    """Strict mode: raise when the conservation report names a failure."""
    failures = report.select("failures").first()[0]
    if failures:
        raise RuntimeError("; ".join(failures))


# --- project metadata -----------------------------------------------------------------------------

META_SCHEMA = f"""struct<data: struct<repository: struct<nameWithOwner: string, id: string, createdAt: string, pushedAt: string,
 stargazerCount: bigint, forkCount: bigint, isFork: boolean, isArchived: boolean, isMirror: boolean, diskUsage: bigint,
 owner: struct<__typename: string, login: string>, primaryLanguage: struct<name: string>,
 languages: struct<edges: array<struct<size: bigint, node: struct<name: string>>>>, licenseInfo: struct<key: string>,
 defaultBranchRef: struct<name: string>, assignableUsers: {_TOTAL}, mentionableUsers: {_TOTAL}, pullRequests: {_TOTAL}, issues: {_TOTAL},
 codeowners_github: {_LOGIN}, codeowners_root: {_LOGIN}, codeowners_docs: {_LOGIN}, pr_template_lower: {_LOGIN},
 pr_template_upper: {_LOGIN}, contributing_md: {_LOGIN}, contributing_rst: {_LOGIN},
 workflows: struct<entries: array<struct<name: string>>>>>>"""


def project_meta_rows(texts: DataFrame) -> DataFrame:
    """Flat project metadata from one JSON text per project (column ``value``)."""
    r = texts.select(F.from_json("value", META_SCHEMA)["data"]["repository"].alias("r")).where(F.col("r").isNotNull())
    edges = F.filter(F.coalesce("r.languages.edges", F.array()), lambda e: e.isNotNull())
    best = F.aggregate(
        edges, F.lit(None).cast("struct<name: string, size: bigint>"),
        lambda a, e: F.when(a.isNull() | (e["size"] > a["size"]),
                            F.struct(e["node"]["name"].alias("name"), e["size"].alias("size"))).otherwise(a))
    any_of = lambda *cs: F.coalesce(*[F.col(f"r.{c}") for c in cs]).isNotNull()
    return coerce_times(r.select(
        *_fields("r", {
            "project": "nameWithOwner",
            "project_id": "id",
            "created_at": "createdAt",
            "pushed_at": "pushedAt",
            "stars_snapshot": "stargazerCount",
            "forks_snapshot": "forkCount",
            "is_fork": "isFork",
            "is_archived": "isArchived",
            "is_mirror": "isMirror",
            "disk_usage": "diskUsage",
            "owner_type": "owner.__typename",
            "owner_login": "owner.login",
            "primary_language": "primaryLanguage.name",
            "license": "licenseInfo.key",
            "default_branch": "defaultBranchRef.name",
            "n_assignable_users": "assignableUsers.totalCount",
            "n_mentionable_users": "mentionableUsers.totalCount",
            "n_subjects": "pullRequests.totalCount",
            "n_issues": "issues.totalCount",
        }),
        F.map_from_entries(F.transform(edges, lambda e: F.struct(e["node"]["name"], e["size"]))).alias("languages"),
        best["name"].alias("language_dominant"),
        any_of("codeowners_github", "codeowners_root", "codeowners_docs").alias("has_codeowners"),
        any_of("pr_template_lower", "pr_template_upper").alias("has_pr_template"),
        any_of("contributing_md", "contributing_rst").alias("has_contributing"),
        F.coalesce(F.size("r.workflows.entries"), F.lit(0)).alias("n_ci_workflows")))


# --- search pages ---------------------------------------------------------------------------------

SEARCH_SCHEMA = """struct<data: struct<search: struct<repositoryCount: bigint, nodes: array<struct<id: string, nameWithOwner: string,
 createdAt: string, pushedAt: string, stargazerCount: bigint, forkCount: bigint, isFork: boolean, isArchived: boolean,
 isMirror: boolean, isPrivate: boolean, primaryLanguage: struct<name: string>,
 languages: struct<edges: array<struct<size: bigint, node: struct<name: string>>>>, pullRequests: struct<totalCount: bigint>>>>>>"""

# Language and star range in a search page's file name.
SEARCH_PATH = r"search_([^/_]+)_(\d+)_(\d+)_p\d+\.json$"


def search_candidates(spark: SparkSession, path: str, pattern: str = SEARCH_PATH) -> DataFrame:
    """Candidate projects of persisted search pages, each with the cell named by its file."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    part = lambda i: F.regexp_extract(F.col("_metadata.file_path"), pattern, i)
    cell = F.concat(F.url_decode(part(1)), F.lit(":"), part(2), F.lit("-"), part(3))
    nodes = F.from_json("value", SEARCH_SCHEMA)["data"]["search"]["nodes"]
    rows = files.select(cell.alias("cell"), nodes.alias("nodes")).select("cell", F.explode("nodes").alias("n")).where("n is not null")
    return coerce_times(rows.select(
        "cell", F.col("n.id").alias("id"), F.col("n.nameWithOwner").alias("project"), F.col("n.createdAt").alias("created_at"),
        F.col("n.pushedAt").alias("pushed_at"), F.col("n.stargazerCount").alias("stars"), F.col("n.isFork").alias("is_fork"),
        F.col("n.isArchived").alias("is_archived"), F.col("n.isMirror").alias("is_mirror"), F.col("n.isPrivate").alias("is_private"),
        F.col("n.primaryLanguage.name").alias("primary_language"),
        F.transform("n.languages.edges", lambda e: F.struct(e["node"]["name"].alias("name"), e["size"].alias("size"))).alias("languages"),
        F.coalesce("n.pullRequests.totalCount", F.lit(0)).alias("n_all")))
