"""Orders and line items written as the raw nested pages and manifest an ingest starts from."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waitline.plans.bindings import _SHARED, OrderTables
from waitline.session import scratch_path, written

# Pages written by Spark lie in one folder per project, tier and page: all side by side, so that they are listed in one step.
FOLDERS = r"/page=([^/]+)-(\d+)-(\d+)/[^/]+$"
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def _iso(expr: str) -> str:
    return f"date_format({expr}, \"{ISO}\")"


#: Fields of one line (``x``) in the pages.
WHO = ("if(x.l_suppkey % 17 = 0, null, named_struct('login', if(x.l_suppkey % 13 = 0, 'helper[bot]', concat('s', x.l_suppkey)),"
       " '__typename', if(x.l_suppkey % 10 = 0, 'Bot', 'User'), 'databaseId', x.l_suppkey, 'createdAt', '2001-01-01T00:00:00Z'))")
ASSOC = "if(x.outsider, 'NONE', 'MEMBER')"
KINDS = ("case x.l_linenumber when 1 then 'ReadyForReviewEvent' when 2 then 'ConvertToDraftEvent' when 3 then 'LabeledEvent'"
         " when 4 then 'UnlabeledEvent' when 5 then 'RenamedTitleEvent' when 6 then 'BaseRefChangedEvent' else 'ReviewRequestedEvent' end")
REVIEW = (
    f"named_struct('id', concat('r', x.l_partkey, '-', x.l_suppkey), 'state', 'COMMENTED', 'createdAt', {_iso('x.at - interval 1 hour')},"
    f" 'submittedAt', if(x.submitted, {_iso('x.at')}, null), 'authorAssociation', {ASSOC}, 'author', {WHO})")
COMMENT = (
    f"named_struct('id', concat('n', x.l_partkey, '-', x.l_suppkey), 'createdAt', {_iso('x.at')}, 'publishedAt', if(x.published, {_iso('x.at')}, null),"
    f" 'isMinimized', x.minimized, 'authorAssociation', {ASSOC}, 'author', {WHO})")
THREAD = ("named_struct('id', concat('t', x.l_partkey, '-', x.l_suppkey), 'isResolved', x.resolved,"
          f" 'comments', named_struct('totalCount', if(x.l_partkey % 30 = 0, 12, 1), 'nodes', array({COMMENT})))")
COMMIT = (f"named_struct('commit', named_struct('oid', concat(x.l_partkey, '-', x.l_suppkey), 'authoredDate', {_iso('x.at')},"
          " 'additions', x.additions, 'deletions', x.l_partkey % 50))")
EVENT = (f"named_struct('__typename', {KINDS}, 'createdAt', {_iso('x.at')}, 'previousTitle', if(x.l_linenumber = 5, concat('was ', x.l_partkey), null),"
         " 'requestedReviewer', if(x.l_linenumber = 7, named_struct('__typename', if(x.l_partkey % 2 = 0, 'Team', 'User'), 'name', concat('s', x.l_suppkey)), null))")


def _pages_of(number: str) -> str:
    """The pages that can hold an order: by its number, and for the lowest numbers also the repeat."""
    return f"explode(if({number} < 5000, array({number} div 5000, 900 + {number} div 5000), array({number} div 5000))) as page_index"


def _lines(t: OrderTables) -> DataFrame:
    """Lines by the number of their order: only what the nested connections are made of, in an order of fields that sorts
    lines like the connections."""
    lines = t._t("lineitem").selectExpr(
        "l_orderkey as number", "cast(l_shipdate as timestamp) as at", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag as flag",
        "coalesce(l_tax < 0.08, false) and l_shipdate is not null as submitted", "not coalesce(l_linestatus = 'O', false) as outsider",
        "coalesce(l_tax > 0, false) and l_shipdate is not null as published", "l_discount > 0.09 as minimized",
        "if(l_linenumber <> 4, cast(l_quantity as bigint), null) as additions", "l_discount > 0.05 as resolved")
    return lines.select("number", F.struct(*[c for c in lines.columns if c != "number"]).alias("line"))


def _node() -> str:
    """The node of one order (``o``) as the page holds it."""
    shape = "if(o.number % 50 = 0, reverse({0}), {0})"
    some = lambda flag, body: shape.format(f"transform(filter(o.items, x -> x.flag = '{flag}'), x -> {body})")
    all_ = lambda body: shape.format(f"transform(o.items, x -> {body})")
    # An order without lines has null connections, which the reader takes as empty.
    conn = lambda entries, size, extra="0": (
        f"named_struct('totalCount', if(o.items is null, 0, size({size})) + {extra}, 'nodes', "
        f"if(o.number % 9 = 0, array_append({entries}, null), {entries}))")
    of = lambda flag: f"filter(o.items, x -> x.flag = '{flag}')"
    return (
        "named_struct('id', o.id, 'databaseId', o.number, 'number', o.number, 'url', concat('https://example.com/', project, '/', o.number),"
        f" 'createdAt', {_iso('o.created_at')}, 'closedAt', {_iso('o.closed_at')}, 'mergedAt', {_iso('o.merged_at')},"
        " 'merged', o.merged_at is not null, 'closed', o.closed_at is not null, 'state', o.o_orderstatus, 'isDraft', o.o_orderstatus = 'P',"
        " 'title', concat('Order ', o.number, ' ', o.o_orderpriority), 'baseRefName', o.o_orderstatus, 'isCrossRepository', o.o_orderpriority = '5-LOW',"
        " 'authorAssociation', o.association_current, 'author', if(o.actor_login is null, null, named_struct('login', o.actor_login, '__typename', o.actor_type, 'databaseId', o.number % 1000)),"
        " 'labels', named_struct('totalCount', if(o.number % 40 = 0, 25, o.number % 4), 'nodes', transform(sequence(0, cast(o.number % 4 as int)), i -> named_struct('name', concat('l', i)))),"
        f" 'reviews', {conn(some('R', REVIEW), of('R'), 'if(o.number % 41 = 0, 60, 0)')}, 'comments', {conn(some('N', COMMENT), of('N'))},"
        f" 'reviewThreads', {conn(some('A', THREAD), of('A'))}, 'commits', {conn(all_(COMMIT), 'o.items')}, 'timelineItems', {conn(all_(EVENT), 'o.items')})")


def _page_rows(t: OrderTables) -> DataFrame:
    """(project, page_index, tiers, n): the orders of a page by number and the tiers that hold it.

    A page holds a bounded key range of one project, in the first tier also a repeat of an earlier page.
    """
    tasks = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    again = "project in ('NATION_1', 'NATION_6', 'NATION_11') and number < 5000"
    placed = t.history().selectExpr("*", f"inline(if({again}, array(named_struct('page_index', number div 5000, 'again', false),"
                                    " named_struct('page_index', 900 + number div 5000, 'again', true)), array(named_struct('page_index', number div 5000, 'again', false))))")
    order = F.struct(*[c for c in placed.columns if c not in ("page_index", "number")])
    kinds = t._t("orders").selectExpr("o_orderkey as number", "named_struct('o_orderpriority', o_orderpriority, 'o_orderstatus', o_orderstatus) as kind")
    # All that a page is made of is dealt to it at once and nothing moves again.  Rows are short here and long as texts, so
    # that Spark is not left to make fewer tasks of them by their size.
    dealt = placed.select("page_index", "number", order.alias("order")).unionByName(
        kinds.selectExpr("*", _pages_of("number")), allowMissingColumns=True).unionByName(
        _lines(t).selectExpr("*", _pages_of("number")), allowMissingColumns=True).where("number is not null").repartition(tasks, "page_index")
    # An order has a handful of lines.  An order row that comes twice meets each of its kind, and its lines come as often.
    met = dealt.groupBy("page_index", "number").agg(*[F.collect_list(c).alias(f"{c}s") for c in ("order", "kind", "line")])
    orders = met.withColumn("items", F.expr("if(size(lines) = 0, null, sort_array(flatten(array_repeat(lines, size(kinds)))))")).selectExpr(
        "page_index", "number", "items", "kinds", "inline(orders)").selectExpr("*", "inline(kinds)")
    # Equal numbers are sorted by the fields of their nodes.
    held = F.struct("number", "id", "created_at", "closed_at", "merged_at", "o_orderstatus", "o_orderpriority", "association_current",
                    "actor_login", "actor_type", "items", "again")
    pages = orders.groupBy("page_index", "project").agg(F.sort_array(F.collect_list(held)).alias("n"))
    return pages.selectExpr("project", "page_index", "inline(if(exists(n, o -> o.again), array(named_struct('tiers', array(1), 'n', n),"
                            " named_struct('tiers', array(2), 'n', filter(n, o -> not o.again))), array(named_struct('tiers', array(1, 2), 'n', n))))").where("size(n) > 0")


def _write(t: OrderTables) -> tuple[str, str]:
    pages, manifest = scratch_path(t.spark, "raw"), scratch_path(t.spark, "manifest")
    rows = written(_page_rows(t), "page-rows")
    value = F.to_json(F.expr(
        f"named_struct('data', named_struct('repository', named_struct('pullRequests', named_struct('nodes', transform(n, o -> {_node()})))))"))
    # Rows are put in the writer's order while they are short; only then their texts are made.  A page without a project lies
    # under the writer's name for it.
    place = F.expr("concat_ws('-', coalesce(nullif(project, ''), '__HIVE_DEFAULT_PARTITION__'), tier, page_index)")
    texts_out = rows.select("project", F.explode("tiers").alias("tier"), "page_index", "n").select(
        place.alias("page"), "project", "n").sortWithinPartitions("page").select("page", value.alias("value"))
    # The line writer ends each file with a newline, which is part of the hashed bytes.
    texts = rows.select("project", "tiers", "page_index", F.size("n").alias("pr_count"), F.sha2(F.concat(value, F.lit("\n")), 256).alias("digest"))
    listed = texts.withColumn("tier", F.explode("tiers")).select(
        "project", "tier", "page_index", F.when((F.expr("cast(substr(project, 8) as int)") % 7 == 3) & (F.col("tier") == 2) & (F.col("page_index") == 0),
                                                F.repeat(F.lit("0"), F.lit(64))).otherwise(F.col("digest")).alias("sha256"),
        F.concat(F.lit("c"), F.col("page_index").cast("string")).alias("cursor_before"), F.col("pr_count").cast("long").alias("pr_count"),
        F.when(F.col("tier") == 1, "v1").otherwise("v2").alias("query_version"))
    nation = t._t("nation").selectExpr("n_name as project", "n_nationkey as k")
    extra = nation.selectExpr("project", "k", "explode(array('missing', 'error', 'stale', 'open', 'bypass', 'meta')) as what").where(
        "(what = 'missing' and k % 7 = 4) or (what = 'error' and k % 7 = 5) or (what = 'stale' and k % 3 = 0)"
        " or (what = 'open' and k % 7 = 6) or (what = 'bypass' and k % 4 = 0) or what = 'meta'").selectExpr(
        "project", "if(what = 'meta', 0, 1) as tier", "case what when 'missing' then 5000 when 'error' then 6000 else 7000 end as page_index",
        "case what when 'stale' then 'c0' when 'open' then 'zz' end as cursor_before", "what = 'error' as has_graphql_errors",
        "if(what in ('stale', 'open'), 'timeout', null) as fatal_transient", "what = 'bypass' as bypass",
        "if(what = 'bypass', array(cast(k as bigint), cast(k + 100 as bigint)), null) as dead_numbers", "if(what = 'missing', 'v1', null) as query_version")
    # Pages and their list are made of the same rows and do not wait for each other.
    with ThreadPoolExecutor(2) as pool:
        for done in [pool.submit(texts_out.write.partitionBy("page").option("compression", "gzip").text, pages),
                     pool.submit(listed.unionByName(extra, allowMissingColumns=True).write.json, manifest)]:
            done.result()
    t.spark.createDataFrame([('{"project": "NATION_1", "ti',)], "value string").coalesce(1).write.mode("append").text(manifest)
    return pages, manifest


def raw(t: OrderTables) -> tuple[str, str]:
    """(pages folder, manifest folder), written once per session and directory."""
    key = (t.spark.sparkContext.applicationId, t.dir, "raw")
    if key not in _SHARED:
        _SHARED[key] = _write(t)
    return _SHARED[key]
