"""Queries over sources, page ingest, flattening and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from waitline.functions.columns import micros
from waitline.plans import oracle_base as o
from waitline.plans.bindings import OrderTables
from waitline.plans.raw_pages import FOLDERS, raw
from waitline.plans.registry import Book
from waitline.session import scratch_path, written
from waitline.sources import pages as P
from waitline.sources import tables as S
from waitline.sources.parse import TABLES, parse
from waitline.streaming import ingest as I

book = Book()
us = lambda c, name: micros(c).cast("string").alias(name)
PK = ("project", "tier", "page_index")

# --- what the raw pages must contain, from the tables ----------------------------------------------

RAW = ", ".join([o.SUBJECTS, o.LINES, o.META, """
ln as (select l.*, cast(l_orderkey as varchar) as id, epoch_us(l_shipdate) as s_us,
   case when l_suppkey % 17 = 0 then null when l_suppkey % 13 = 0 then 'helper[bot]' else concat('s', l_suppkey) end as login,
   case when l_suppkey % 17 = 0 then null when l_suppkey % 10 = 0 then 'Bot' else 'User' end as type,
   case when l_linestatus = 'O' then 'MEMBER' else 'NONE' end as association from lin l),
nat as (select n_name as project, n_nationkey as k from nation),
s1 as (select s.*, number // 5000 as page from subj s),
s2 as (select * from s1 join nat using (project) where not (k % 7 = 3 and page = 0)),
pg as (select project, page, tier from (select distinct project, page from s1) cross join (values (1), (2)) v(tier)
       union select project, 900 + page, 1 from s1 where project in ('NATION_1', 'NATION_6', 'NATION_11') and number < 5000)"""])


def inputs(spark, sf):
    t = OrderTables(spark, sf)
    folder, manifest = raw(t)
    return t, P.read_manifest(spark, manifest).where("not torn"), P.read_pages(spark, folder, FOLDERS)


def all_nodes(spark, sf, fields=P.NODE_FIELDS):
    _, m, pages = inputs(spark, sf)
    return P.page_nodes(P.good_pages(P.page_records(m), pages), fields)


def nodes(spark, sf, fields):
    """The first node of every id, with the fields that are read of it."""
    return P.first_nodes(all_nodes(spark, sf, fields))


def whole(*names):
    return {n: P.NODE_FIELDS[n] for n in names}


@book.query("s1_load_entities", o.with_(o.SUBJECTS, o.KEPT) + """
select id, project, title_current from subj where project in ('NATION_1', 'NATION_2', 'NATION_3') union all select id, project, null from subj where number < 0""")
def s1_load_entities(spark, sf):
    t = OrderTables(spark, sf)
    root, rows = scratch_path(spark, "entities"), t.subjects()
    S.write_entity(rows, root, "subjects")
    some = S.load_entity(spark, root, "subjects", rows.schema, ["NATION_1", "NATION_2", "NATION_3"])
    absent = S.load_entity(spark, root, "never_written", rows.select("id", "project").schema)
    return S.union_all([some, absent]).select("id", "project", "title_current")


@book.query("s2_read_pages", o.with_(RAW) + """
select project, tier, page as page_index, count(*) as n from pg join s1 using (project, page) where not (tier = 2 and page = 0 and project in (select project from nat where k % 7 = 3))
group by all union all select project, 1, 900 + page, count(*) from s1 where project in ('NATION_1', 'NATION_6', 'NATION_11') and number < 5000 group by all""")
def s2_read_pages(spark, sf):
    return all_nodes(spark, sf, {}).groupBy(*PK).agg(F.count("*").alias("n"))


@book.query("s3_read_manifest", o.with_(RAW) + """
select 1::bigint as torn, (select count(*) from pg) + (select count(*) filter (k % 7 = 4) + count(*) filter (k % 7 = 5) + count(*) filter (k % 3 = 0)
  + count(*) filter (k % 7 = 6) + count(*) filter (k % 4 = 0) + count(*) from nat) as sound""")
def s3_read_manifest(spark, sf):
    m = P.read_manifest(spark, raw(OrderTables(spark, sf))[1])
    return m.select("torn", "project").agg(F.count_if("torn").alias("torn"), F.count_if(~F.col("torn")).alias("sound"))


@book.query("s4_page_status", o.with_(RAW) + """
select project, tier, page as page_index, case when tier = 2 and page = 0 and k % 7 = 3 then 'hash mismatch' else 'ok' end as status from pg join nat using (project)
union all select project, 1, 5000, 'missing' from nat where k % 7 = 4 and project in (select project from pg)
union all select project, 1, 5000, 'missing' from nat where k % 7 = 4 and project not in (select project from pg)""")
def s4_page_status(spark, sf):
    _, m, pages = inputs(spark, sf)
    return P.page_status(P.page_records(m), pages)


@book.query("s5_giveups", o.with_(o.ORDERS, o.MANIFEST) + """
select project, tier, page_index, exists (select 1 from man s where s.fatal_transient is null and s.project = m.project and s.tier = m.tier
   and s.cursor_before = m.cursor_before) as resolved from man m where fatal_transient is not null""")
def s5_giveups(spark, sf):
    return P.giveups(OrderTables(spark, sf).manifest()).select(*PK, "resolved")


@book.query("s6_dead_numbers", o.with_(o.ORDERS, o.MANIFEST) + """
select distinct project, unnest(dead_numbers) as number from man where bypass and fatal_transient is null""")
def s6_dead_numbers(spark, sf):
    return P.dead_numbers(OrderTables(spark, sf).manifest())


@book.query("s7_page_records", o.with_(o.ORDERS, o.MANIFEST) + """
select project, tier, page_index from man where fatal_transient is null and not bypass and tier <> 0 and not coalesce(has_graphql_errors, false)""")
def s7_page_records(spark, sf):
    return P.page_records(OrderTables(spark, sf).manifest()).select(*PK)


@book.query("s7_error_records", o.with_(o.ORDERS, o.MANIFEST) + """
select project, tier, page_index, 'page with errors' as problem from man where fatal_transient is null and not bypass and tier <> 0 and coalesce(has_graphql_errors, false)
union all select project, tier, page_index, 'unresolved give-up' from man m where fatal_transient is not null and not exists (
  select 1 from man s where s.fatal_transient is null and s.project = m.project and s.tier = m.tier and s.cursor_before = m.cursor_before)""")
def s7_error_records(spark, sf):
    return P.error_records(OrderTables(spark, sf).manifest())


@book.query("s8_first_nodes", o.with_(RAW) + """
select project, 1 as tier, id, page as page_index from s1 union all select project, 2, id, page from s2""")
def s8_first_nodes(spark, sf):
    return nodes(spark, sf, {}).select("project", "tier", F.col("node.id").alias("id"), "page_index")


@book.query("s9_history_rows", o.with_(RAW, "cnt as (select id, count(*) filter (l_returnflag = 'R') as r, count(*) filter (l_returnflag = 'A') as a, count(*) filter (l_returnflag = 'N') as n from ln group by id)") + """
select project, id, number, cast(c_us as varchar) as c_us, cast(x_us as varchar) as x_us, cast(m_us as varchar) as m_us, actor_login, actor_login is null as actor_is_deleted,
  cast(actor_is_bot as varchar) as actor_is_bot, association_current, coalesce(r, 0) + case when number % 41 = 0 then 60 else 0 end as n_reviews, coalesce(n, 0) as n_comments, coalesce(a, 0) as n_threads
from s1 left join cnt using (id)""")
def s9_history_rows(spark, sf):
    return P.history_rows(nodes(spark, sf, P.HISTORY_FIELDS)).select(
        "project", "id", "number", us("created_at", "c_us"), us("closed_at", "x_us"), us("merged_at", "m_us"), "actor_login",
        "actor_is_deleted", F.col("actor_is_bot").cast("string").alias("actor_is_bot"), "association_current", "n_reviews", "n_comments", "n_threads")


DIFF = """
dif as (select s.id, count(l_orderkey) as n, count(*) filter (s_us <= c_us) as e, sum(case when s_us <= c_us then (case when l_linenumber <> 4 then cast(l_quantity as bigint) else 0 end) end)::bigint as ad,
   sum(case when s_us <= c_us then l_partkey % 50 end)::bigint as de, count(*) filter (l_returnflag = 'R') as r,
   coalesce(bool_or(l_returnflag = 'A' and l_partkey % 30 = 0), false) as deep from s2 s left join ln using (id) group by s.id),
trn as (select id, number % 41 = 0 or number % 40 = 0 or deep or n > 30 as is_truncated from s2 join dif using (id))"""


@book.query("s10_subject_rows", o.with_(RAW, DIFF) + """
select s.id, title_current, is_draft_current, number % 4 as ncap, case when number % 40 = 0 then 25 else number % 4 end as n_labels_current,
  r + case when number % 41 = 0 then 60 else 0 end as n_reviews, r as n_reviews_captured, n as n_commits_captured from s2 s join dif using (id)""")
def s10_subject_rows(spark, sf):
    return P.subject_rows(nodes(spark, sf, P.SUBJECT_FIELDS)).select(
        "id", "title_current", "is_draft_current", (F.size("labels_current") - 1).cast("long").alias("ncap"), "n_labels_current",
        "n_reviews", F.col("n_reviews_captured").cast("long").alias("n_reviews_captured"), F.col("n_commits_captured").cast("long").alias("n_commits_captured"))


@book.query("s11_actor", o.with_(RAW) + """
select actor_login, actor_login is null as actor_is_deleted, cast(actor_is_bot as varchar) as actor_is_bot, count(*) as n
from (select actor_login, actor_is_bot from s1 union all select actor_login, actor_is_bot from s2) group by all""")
def s11_actor(spark, sf):
    rows = nodes(spark, sf, whole("author")).select(*P.actor_columns("node.author"))
    return rows.groupBy("actor_login", "actor_is_deleted", F.col("actor_is_bot").cast("string").alias("actor_is_bot")).agg(F.count("*").alias("n"))


@book.query("s12_connection", o.with_(RAW, DIFF) + """
select id, n as captured, n as total from s2 join dif using (id)""")
def s12_connection(spark, sf):
    entries, n = P.connection("node", "timelineItems")
    return nodes(spark, sf, whole("timelineItems")).where("tier = 2").select(F.col("node.id").alias("id"), F.size(entries).cast("long").alias("captured"), n.alias("total"))


@book.query("s13_diff_at_open", o.with_(RAW, DIFF) + """
select id, cast(ad as varchar) as additions, cast(de as varchar) as deletions, cast(nullif(e, 0) as varchar) as n_commits,
       n = 1 and e = 1 and not is_truncated as diff_is_exact from dif join trn using (id)""")
def s13_diff_at_open(spark, sf):
    return P.subject_rows(nodes(spark, sf, P.SUBJECT_FIELDS)).select(
        "id", F.col("additions_at_open").cast("string").alias("additions"), F.col("deletions_at_open").cast("string").alias("deletions"),
        F.col("n_commits_at_open").cast("string").alias("n_commits"), "diff_is_exact")


@book.query("s14_reviews", o.with_(RAW) + f"""
select id, concat('r', l_partkey, '-', l_suppkey) as response_id, cast(s_us - {o.HOUR} as varchar) as c_us, case when l_tax < 0.08 then cast(s_us as varchar) end as v_us, login, type, association
from s2 join ln using (id) where l_returnflag = 'R'""")
def s14_reviews(spark, sf):
    return P.review_rows(nodes(spark, sf, whole("reviews"))).select(
        "id", "response_id", us("created_at", "c_us"), us("submitted_at", "v_us"), "login", "type", "association")


@book.query("s15_thread_comments", o.with_(RAW) + """
select id, concat('t', l_partkey, '-', l_suppkey) as thread_id, l_discount > 0.05 as thread_is_resolved, case when l_partkey % 30 = 0 then 12 else 1 end as thread_n_comments,
  concat('n', l_partkey, '-', l_suppkey) as response_id, cast(s_us as varchar) as c_us, login, l_discount > 0.09 as is_minimized
from s2 join ln using (id) where l_returnflag = 'A'""")
def s15_thread_comments(spark, sf):
    return P.thread_comment_rows(nodes(spark, sf, whole("reviewThreads"))).select(
        "id", "thread_id", "thread_is_resolved", F.col("thread_n_comments").cast("int").alias("thread_n_comments"), "response_id",
        us("created_at", "c_us"), "login", "is_minimized")


@book.query("s16_issue_comments", o.with_(RAW) + """
select id, concat('n', l_partkey, '-', l_suppkey) as response_id, cast(s_us as varchar) as c_us, case when l_tax > 0 then cast(s_us as varchar) end as p_us, login, association
from s2 join ln using (id) where l_returnflag = 'N'""")
def s16_issue_comments(spark, sf):
    return P.issue_comment_rows(nodes(spark, sf, whole("comments"))).select(
        "id", "response_id", us("created_at", "c_us"), us("published_at", "p_us"), "login", "association")


@book.query("s17_timeline", o.with_(RAW) + """
select id, case l_linenumber when 1 then 'ReadyForReviewEvent' when 2 then 'ConvertToDraftEvent' when 3 then 'LabeledEvent' when 4 then 'UnlabeledEvent'
  when 5 then 'RenamedTitleEvent' when 6 then 'BaseRefChangedEvent' else 'ReviewRequestedEvent' end as event_type, cast(s_us as varchar) as c_us,
  case when l_linenumber = 5 then concat('was ', l_partkey) end as previous_title,
  case when l_linenumber = 7 then (case when l_partkey % 2 = 0 then 'Team' else 'User' end) end as requested_type,
  case when l_linenumber = 7 then concat('s', l_suppkey) end as requested from s2 join ln using (id)""")
def s17_timeline(spark, sf):
    return P.timeline_rows(nodes(spark, sf, whole("timelineItems"))).select("id", "event_type", us("created_at", "c_us"), "previous_title", "requested_type", "requested")


@book.query("s18_commits", o.with_(RAW) + """
select id, concat(l_partkey, '-', l_suppkey) as oid, cast(s_us as varchar) as a_us, case when l_linenumber <> 4 then cast(cast(l_quantity as bigint) as varchar) end as additions,
  l_partkey % 50 as deletions from s2 join ln using (id)""")
def s18_commits(spark, sf):
    return P.commit_rows(nodes(spark, sf, whole("commits"))).select(
        "id", "oid", us("authored_date", "a_us"), F.col("additions").cast("string").alias("additions"), "deletions")


@book.query("s19_truncated", o.with_(RAW, DIFF) + "select id, is_truncated from trn")
def s19_truncated(spark, sf):
    return P.subject_rows(nodes(spark, sf, P.SUBJECT_FIELDS)).select("id", "is_truncated")


@book.query("s20_order_violations", o.with_(RAW, """
stm as (select id, 'timeline' as stream, s_us as v, l_partkey, l_suppkey, l_linenumber, l_returnflag from s2 join ln using (id) where number % 50 = 0
  union all select id, 'reviews_submitted', s_us, l_partkey, l_suppkey, l_linenumber, l_returnflag from s2 join ln using (id) where number % 50 = 0 and l_returnflag = 'R' and l_tax < 0.08
  union all select id, 'issue_comments', s_us, l_partkey, l_suppkey, l_linenumber, l_returnflag from s2 join ln using (id) where number % 50 = 0 and l_returnflag = 'N'),
sq as (select *, row_number() over w - 1 as i, lead(v) over w as nx from stm window w as (partition by id, stream order by v desc, l_partkey desc, l_suppkey desc, l_linenumber desc))""") + """
select id, stream, min(i) as index from sq where v > nx group by id, stream""")
def s20_order_violations(spark, sf):
    return P.order_violations(nodes(spark, sf, P.CHECKED_FIELDS)).select("id", "stream", F.col("index").cast("long").alias("index"))


@book.query("s21_coerce_times", o.with_(o.SUBJECTS) + """
select id, case when number % 3 = 0 then null else cast(c_us as varchar) end as us, text from (select *, case when number % 3 = 0 then 'not a time' else 'kept' end as text from subj)""")
def s21_coerce_times(spark, sf):
    raw_ = OrderTables(spark, sf).history().select(
        "id", F.when(F.col("number") % 3 == 0, "not a time").otherwise(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("made_at"),
        F.when(F.col("number") % 3 == 0, "not a time").otherwise("kept").alias("text"))
    return P.coerce_times(raw_).select("id", us("made_at", "us"), "text")


def meta_texts(spark, sf):
    """One raw metadata text per project."""
    t = OrderTables(spark, sf)
    place = t.history().select("id", "project")
    sizes = t._t("lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_returnflag").alias("name"), "l_quantity").join(place, "id").groupBy(
        "project", "name").agg(F.sum("l_quantity").cast("long").alias("size"))
    langs = sizes.groupBy("project").agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("ls"))
    return t.project_meta().drop("language_dominant").join(langs, "project", "left").selectExpr(
        "to_json(named_struct('data', named_struct('repository', named_struct('nameWithOwner', project, 'createdAt', date_format(created_at, \"yyyy-MM-dd'T'HH:mm:ss'Z'\"),"
        " 'owner', named_struct('__typename', owner_type), 'defaultBranchRef', named_struct('name', default_branch),"
        " 'languages', named_struct('edges', transform(ls, x -> named_struct('size', x.size, 'node', named_struct('name', x.name)))),"
        " 'assignableUsers', named_struct('totalCount', n_assignable_users), 'codeowners_root', if(has_codeowners, named_struct('login', 'x'), null),"
        " 'pr_template_upper', if(has_pr_template, named_struct('login', 'x'), null), 'contributing_md', if(has_contributing, named_struct('login', 'x'), null),"
        " 'workflows', if(n_ci_workflows = 0, null, named_struct('entries', transform(sequence(1, n_ci_workflows), i -> named_struct('name', cast(i as string))))))))) as value")


@book.query("s22_project_meta", o.with_(o.META, """
sz as (select n_name as project, l_returnflag as name, floor(sum(l_quantity))::bigint as size from lineitem join orders on l_orderkey = o_orderkey
   join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all),
dm as (select project, name from (select *, row_number() over (partition by project order by size desc, name) as rn from sz) where rn = 1)""") + """
select project, cast(p_us as varchar) as p_us, owner_type, dm.name as language_dominant, default_branch, n_assignable_users, has_codeowners, has_pr_template, has_contributing,
  n_ci_workflows from meta left join dm using (project)""")
def s22_project_meta(spark, sf):
    texts = meta_texts(spark, sf)
    return P.project_meta_rows(texts).select(
        "project", us("created_at", "p_us"), "owner_type", "language_dominant", "default_branch", "n_assignable_users",
        "has_codeowners", "has_pr_template", "has_contributing", F.col("n_ci_workflows").cast("long").alias("n_ci_workflows"))


@book.query("s23_conservation", o.with_(RAW, DIFF) + """
select (select count(*) from pg) - (select count(*) from pg join nat using (project) where tier = 2 and page = 0 and k % 7 = 3) as pages_read,
  (select count(*) from pg join nat using (project) where tier = 2 and page = 0 and k % 7 = 3) + (select count(*) from nat where k % 7 = 4) as pages_bad,
  (select count(*) from s1) + (select count(*) from s2) as unique_subjects,
  (select count(*) from s1 where project in ('NATION_1', 'NATION_6', 'NATION_11') and number < 5000) as duplicate_rows,
  (select count(*) filter (is_truncated) from trn) as truncated_subjects, (select 2 * count(*) filter (k % 4 = 0) from nat) as dead_subjects,
  (select count(*) filter (k % 7 = 5) + count(*) filter (k % 7 = 6) from nat) as error_pages,
  'unreadable or altered pages;error pages;order violations;mixed query versions' as failures""")
def s23_conservation(spark, sf):
    _, m, pages = inputs(spark, sf)
    # The parsed nodes are counted in several ways, so pages are parsed once.
    seen = written(all_nodes(spark, sf, P.CHECKED_FIELDS), "nodes")
    out = P.conservation(m, P.page_status(P.page_records(m), pages), seen, P.first_nodes(seen))
    return out.select("pages_read", "pages_bad", "unique_subjects", "duplicate_rows", "truncated_subjects", "dead_subjects", "error_pages",
                      F.array_join("failures", ";").alias("failures"))


@book.query("s24_write_entities", o.with_(RAW) + """
select project, l_returnflag as flag, count(*) as n from s2 join ln using (id) group by all""")
def s24_write_entities(spark, sf):
    root = scratch_path(spark, "entities")
    rows = P.response_rows(nodes(spark, sf, P.RESPONSE_FIELDS))
    S.write_entity(rows, root, "responses")
    flag = F.expr("case stream when 'reviews' then 'R' when 'thread_comments' then 'A' else 'N' end").alias("flag")
    return S.load_entity(spark, root, "responses", rows.schema).groupBy("project", flag).agg(F.count("*").alias("n"))


@book.query("s2_parse", o.with_(RAW, DIFF) + """
select (select count(*) from pg) - (select count(*) from pg join nat using (project) where tier = 2 and page = 0 and k % 7 = 3) as pages_read,
  (select count(*) from pg join nat using (project) where tier = 2 and page = 0 and k % 7 = 3) + (select count(*) from nat where k % 7 = 4) as pages_bad,
  (select count(*) from s1) + (select count(*) from s2) as unique_subjects, (select count(*) from s1) as n_history, (select count(*) from s2) as n_subjects,
  (select count(*) from s2 join ln using (id) where l_returnflag = 'R') as n_reviews, (select count(*) from s2 join ln using (id) where l_returnflag = 'A') as n_thread_comments,
  (select count(*) from s2 join ln using (id) where l_returnflag = 'N') as n_issue_comments, (select count(*) from s2 join ln using (id)) as n_timeline,
  (select count(*) from s2 join ln using (id)) as n_commits, (select count(*) from nat) as n_project_meta,
  'unreadable or altered pages;error pages;order violations;mixed query versions' as failures""")
def s2_parse(spark, sf):
    """Manifest and pages to eight tables and their report, from one call."""
    folder, manifest = raw(OrderTables(spark, sf))
    report = parse(spark, manifest, folder, scratch_path(spark, "parsed"), FOLDERS, meta_texts(spark, sf))
    return report.select("pages_read", "pages_bad", "unique_subjects", *[f"n_{t}" for t in TABLES], F.array_join("failures", ";").alias("failures"))


@book.query("s2_parsed_tables", o.with_(RAW) + """
select project, 'history' as entity, count(*) as n from s1 group by project union all select project, 'subjects', count(*) from s2 group by project
union all select project, 'commits', count(*) from s2 join ln using (id) group by project""")
def s2_parsed_tables(spark, sf):
    """Rows per project of three of the tables, read back from disk."""
    folder, manifest = raw(OrderTables(spark, sf))
    root = scratch_path(spark, "parsed")
    parse(spark, manifest, folder, root, FOLDERS)
    read = [spark.read.parquet(f"{root}/{e}").groupBy("project").agg(F.count("*").alias("n")).select("project", F.lit(e).alias("entity"), "n")
            for e in ("history", "subjects", "commits")]
    return S.union_all(read)


@book.query("s25_write_features", o.with_(o.SUBJECTS, o.KEPT, o.MODEL_ROWS) + """
select count(*) as n, '1' as version from mrows where project in (select project from kept)""")
def s25_write_features(spark, sf):
    root = scratch_path(spark, "features")
    S.write_features(OrderTables(spark, sf).feature_table(), root, "1")
    table = spark.read.parquet(f"{root}/features")
    return table.agg(F.count("*").alias("n")).withColumn("version", F.lit(S.build_facts(table)["version"]))


@book.query("s26_experiment_log", o.with_(o.SCENARIOS) + """
select scenario, cast(fold as integer) as fold, 'baseline' as model, count(*) * 2 as n_test from scen group by scenario, fold""")
def s26_experiment_log(spark, sf):
    path = scratch_path(spark, "log")
    rows = OrderTables(spark, sf).scenarios().groupBy("scenario", "fold").agg(F.count("*").alias("n_test")).withColumn("model", F.lit("baseline"))
    S.log_runs(rows, path)
    S.log_runs(rows, path)
    return S.read_log(spark, path).groupBy("scenario", "fold", "model").agg(F.sum("n_test").alias("n_test"))


@book.query("s27_result_sinks", o.with_(o.PREDICTIONS) + """
select project, count(*) as n from pred group by project union all select project, count(*) from pred group by project""")
def s27_result_sinks(spark, sf):
    path = scratch_path(spark, "results")
    rows = OrderTables(spark, sf).predictions().groupBy("project").agg(F.count("*").alias("n"))
    S.write_result(rows, path + "/json")
    S.write_result(rows, path + "/csv", "csv")
    schema = "project string, n long"
    return spark.read.schema(schema).json(path + "/json").unionByName(spark.read.schema(schema).option("header", "true").csv(path + "/csv"))


@book.query("s28_resumable_ingest", o.with_(RAW) + """
select project, 1 as tier, count(*) as n, count(*) as n_ids, sum(page)::bigint as pages from s1 group by project
union all select project, 2, count(*), count(*), sum(page)::bigint from s2 group by project""")
def s28_resumable_ingest(spark, sf):
    """The later half of the pages, then the earlier with a repeat, then once more: every id lands once, from its earliest page."""
    source, sink, checkpoint = I.fresh_paths(spark)
    rows = all_nodes(spark, sf).select(
        "project", "tier", F.col("node.id").alias("id"), "page_index", F.to_json("node").alias("payload"))
    schema = "project string, tier int, id string, page_index long, payload string"
    first = F.col("page_index") >= 900
    rows.where(first).write.mode("append").parquet(source)
    I.ingest(spark, source, schema, sink, checkpoint)
    rows.where(~first).write.mode("append").parquet(source)
    rows.where(first).write.mode("append").parquet(source)
    I.ingest(spark, source, schema, sink, checkpoint)
    I.ingest(spark, source, schema, sink, checkpoint)
    return I.landed(spark, sink).groupBy("project", "tier").agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"), F.sum("page_index").alias("pages"))


@book.query("s29_search_candidates", o.with_(o.CANDIDATES) + """
select id, concat(primary_language, ':', 0, '-', 10000) as cell, n_all, dominant from cand""")
def s29_search_candidates(spark, sf):
    from waitline.operators.cohort import dominant_language

    path = scratch_path(spark, "search")
    c = OrderTables(spark, sf).candidates()
    # One text per (cell, block of candidates), as a search page would hold; blocks are bounded.
    pages = c.withColumn("block", F.expr("cast(id as bigint) div 50")).groupBy("primary_language", "block").agg(F.to_json(F.expr(
        "named_struct('data', named_struct('search', named_struct('nodes', collect_list(named_struct('id', id, 'nameWithOwner', concat('c/', id),"
        " 'primaryLanguage', named_struct('name', primary_language), 'languages', named_struct('edges', transform(languages, x ->"
        " named_struct('size', x.size, 'node', named_struct('name', x.name)))), 'pullRequests', named_struct('totalCount', n_all))))))")).alias("value"))
    pages.repartition("primary_language", "block").write.partitionBy("primary_language", "block").text(path)
    found = P.search_candidates(spark, path, r"primary_language=([^/]+)/block=(\d+)/()[^/]+$")
    named = dominant_language(found.withColumn("languages", F.coalesce("languages", F.expr("filter(array(named_struct('name', '', 'size', 0L)), x -> false)"))))
    return named.select("id", F.concat("primary_language", F.lit(":0-10000")).alias("cell"), "n_all", F.col("language_dominant").alias("dominant"))


QUERIES, ORACLES = book.queries, book.oracles
