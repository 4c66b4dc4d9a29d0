import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from waitline.plans import raw_pages
from waitline.plans.bindings import OrderTables
from waitline.sources import pages as P
from waitline.sources import tables as S
from waitline.sources.parse import TABLES, good_nodes, parse, parsed_pages
from waitline.streaming import ingest as I


def node(i, **extra):
    return {"id": i, "number": int(i[1:]), "createdAt": "2025-01-01T00:00:00Z", "author": {"login": "al", "__typename": "User"}, **extra}


def write_page(root, tier, index, nodes, project="acme__tool"):
    body = json.dumps({"data": {"repository": {"pullRequests": {"nodes": nodes}}}}).encode()
    folder = root / project / f"tier{tier}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"page_{index:04d}.json.gz").write_bytes(gzip.compress(body))
    return {"project": "acme/tool", "tier": tier, "page_index": index, "sha256": hashlib.sha256(body).hexdigest(), "query_version": "v1"}


@pytest.fixture()
def collected(tmp_path):
    pages = tmp_path / "raw"
    records = [
        write_page(pages, 1, 0, [node("n1"), None, node("n2", author=None)]),
        write_page(pages, 1, 1, [node("n2", title="again"), node("n3")]),
        write_page(pages, 2, 0, [node("n1", commits={"totalCount": 1, "nodes": [{"commit": {
            "oid": "x", "authoredDate": "2024-12-31T00:00:00Z", "additions": 0, "deletions": 7}}]},
            reviews={"totalCount": 2, "nodes": [{"id": "r2", "submittedAt": "2025-01-03T00:00:00Z"}, None,
                                                {"id": "r1", "submittedAt": "2025-01-02T00:00:00Z"}]},
            reviewThreads={"totalCount": 1, "nodes": [{"id": "t1", "comments": {"totalCount": 11, "nodes": [{"id": "c1", "createdAt": "bad"}]}}]})]),
        {"project": "acme/tool", "tier": 1, "page_index": 9, "sha256": "0"},
        {"project": "acme/tool", "tier": 1, "page_index": 5, "fatal_transient": "502", "cursor_before": "k"},
        {"project": "acme/tool", "tier": 1, "page_index": 6, "bypass": True, "dead_numbers": [4, 5], "cursor_before": "k"},
        {"project": "acme/tool", "tier": 1, "page_index": 7, "fatal_transient": "502"},
        {"project": "acme/tool", "tier": 2, "page_index": 8, "has_graphql_errors": True},
    ]
    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text("\n".join(json.dumps(r) for r in records) + "\n\n" + '{"project": "acme/tool", "ti')
    (pages / "acme__tool" / "tier2" / "page_0099.json.gz").write_bytes(b"\x1f\x8b broken")
    return str(pages), str(manifest)


def test_page_ingest(spark, collected):
    pages_dir, manifest = collected
    m = P.read_manifest(spark, manifest)
    assert m.where("torn").count() == 1 and m.where("not torn").count() == 8
    m = m.where("not torn")
    pages = P.read_pages(spark, pages_dir)
    records = P.page_records(m)
    assert {(r.tier, r.page_index, r.status) for r in P.page_status(records, pages).collect()} == {
        (1, 0, "ok"), (1, 1, "ok"), (2, 0, "ok"), (1, 9, "missing")}
    seen = P.page_nodes(P.good_pages(records, pages))
    first = P.first_nodes(seen)
    assert seen.count() == 5 and first.count() == 4
    assert {(r.project, r.page_index) for r in first.where("tier = 1 and node.id = 'n2'").collect()} == {("acme/tool", 0)}
    gone = {r.id: r.actor_is_deleted for r in P.history_rows(first).collect()}
    assert gone == {"n1": False, "n2": True, "n3": False}
    s = P.subject_rows(first).first()
    assert (s.additions_at_open, s.deletions_at_open, s.n_commits_at_open, s.is_truncated, s.diff_is_exact) == (0, 7, 1, True, False)
    assert P.review_rows(first).count() == 2
    assert P.thread_comment_rows(first).first().created_at is None
    v = P.order_violations(first).collect()
    assert [(r.stream, r["index"]) for r in v] == [("reviews_submitted", 0)]
    assert sorted(r.number for r in P.dead_numbers(m).collect()) == [4, 5]
    assert {r.resolved for r in P.giveups(m).where("page_index = 5").collect()} == {True}
    assert {r.resolved for r in P.giveups(m).where("page_index = 7").collect()} == {False}
    report = P.conservation(m, P.page_status(records, pages), seen, first)
    r = report.first()
    assert (r.pages_read, r.pages_bad, r.rows_seen, r.unique_subjects, r.duplicate_rows, r.error_pages) == (3, 1, 5, 4, 1, 2)
    with pytest.raises(RuntimeError, match="order violations"):
        P.require_sound(report)


def test_interrupted_ingest_adds_nothing_twice(spark, tmp_path):
    src, sink, chk = (str(tmp_path / n) for n in ("src", "sink", "chk"))
    schema = "project string, tier int, id string, page_index long, payload string"
    a = spark.createDataFrame([("p", 1, f"i{i}", i // 10, f"x{i}") for i in range(50)], schema)
    a.write.parquet(src)
    I.ingest(spark, src, schema, sink, chk)
    more = spark.createDataFrame([("p", 1, f"i{i}", i // 10, f"x{i}") for i in range(40, 80)], schema)
    more.write.mode("append").parquet(src)
    I.ingest(spark, src, schema, sink, chk)
    I.ingest(spark, src, schema, sink, chk)
    landed = I.landed(spark, sink)
    assert landed.count() == 80 and landed.select("id").distinct().count() == 80
    assert {r.page_index for r in landed.where("id = 'i41'").collect()} == {4}


def pages_of(spark, *rows):
    return spark.createDataFrame([("p", 1, i, page, f"{i}@{page}") for i, page in rows], I.SCHEMA)


def state(spark, sink):
    return {r.id: r.page_index for r in I.landed(spark, sink).collect()}


def test_log_keeps_the_earliest_page_whatever_the_order(spark, tmp_path):
    sink = str(tmp_path / "sink")
    assert state(spark, sink) == {}
    I.land(pages_of(spark, ("a", 7), ("b", 3), ("b", 5)), sink, "b1")
    I.land(pages_of(spark, ("a", 2), ("b", 9), ("c", 1)), sink, "b2")
    I.land(pages_of(spark, ("a", 1), ("d", 1)), sink, "b2")  # replayed after its commit
    assert state(spark, sink) == {"a": 2, "b": 3, "c": 1}


def test_what_is_not_committed_is_not_read(spark, tmp_path, monkeypatch):
    sink = str(tmp_path / "sink")
    I.land(pages_of(spark, ("a", 7)), sink, "b1")
    pages_of(spark, ("a", 1), ("x", 1)).write.partitionBy("project").parquet(f"{sink}/data/b2-dead")  # a crash before the commit
    assert state(spark, sink) == {"a": 7}
    I.land(pages_of(spark, ("a", 1), ("x", 1)), sink, "b2")
    assert state(spark, sink) == {"a": 1, "x": 1}


def test_compaction_merges_by_tier_and_changes_nothing(spark, tmp_path):
    sink = str(tmp_path / "sink")
    want = {}
    for n in range(9):
        rows = [(f"k{(n * 7 + j) % 11}", (n * 5 + j) % 13) for j in range(4)]
        for k, page in rows:
            want[k] = min(want.get(k, 99), page)
        before = {e.path for e in I.live_entries(spark, sink)}
        I.land(pages_of(spark, *rows), sink, f"b{n}")
        assert before < {e.path for e in I.live_entries(spark, sink)}  # a batch rewrites nothing
        I.compact(spark, sink, fan=3)
        assert state(spark, sink) == want
    assert [e.tier for e in I.live_entries(spark, sink)] == [2]


def test_parse_writes_eight_tables_and_reports_them(spark, collected, tmp_path):
    pages_dir, manifest = collected
    root = str(tmp_path / "out")
    meta = spark.createDataFrame([('{"data": {"repository": {"nameWithOwner": "acme/tool", "id": "R"}}}',)], "value string")
    r = parse(spark, manifest, pages_dir, root, meta=meta).first()
    assert (r.pages_read, r.pages_bad, r.rows_seen, r.unique_subjects, r.duplicate_rows, r.error_pages) == (3, 1, 5, 4, 1, 2)
    assert (r.n_history, r.n_subjects, r.n_reviews, r.n_thread_comments, r.n_commits, r.n_project_meta) == (3, 1, 2, 1, 1, 1)
    assert "written rows do not add up" not in r.failures
    for name in TABLES:
        if r[f"n_{name}"]:
            assert spark.read.parquet(f"{root}/{name}").count() == r[f"n_{name}"]
    with pytest.raises(RuntimeError, match="order violations"):
        parse(spark, manifest, pages_dir, str(tmp_path / "strict"), strict=True)


def test_build_facts_travel_in_the_footer(spark, tmp_path):
    S.write_features(spark.createDataFrame([("a", 1)], "id string, n long"), str(tmp_path), "7")
    again = spark.read.parquet(f"{tmp_path}/features")
    assert S.build_facts(again)["version"] == "7" and again.columns == ["id", "n"]
    with pytest.raises(ValueError, match="no build facts"):
        S.build_facts(spark.createDataFrame([("a",)], "id string"))


def test_absent_tables_are_empty_and_log_is_strict(spark, tmp_path):
    schema = S.schema_of("project string, id string, n long")
    assert S.load_entity(spark, str(tmp_path), "nothing", schema).count() == 0
    rows = spark.createDataFrame([("a", "1", 1), ("b", "2", 2)], schema)
    S.write_entity(rows, str(tmp_path), "rows")
    assert S.load_entity(spark, str(tmp_path), "rows", schema, ["a"]).count() == 1
    with pytest.raises(KeyError, match="colour"):
        S.log_runs(spark.createDataFrame([("A", "red")], "scenario string, colour string"), str(tmp_path / "log"))
    S.log_runs(spark.createDataFrame([("A", 0.5)], "scenario string, auc_pr double"), str(tmp_path / "log"))
    assert S.read_log(spark, str(tmp_path / "log")).first().auc_pr == 0.5


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_texts_stay_where_they_are_read(spark, collected, tmp_path):
    """However long the manifest, only digests are shuffled; a page listed twice comes twice, one not listed not at all."""
    pages_dir, manifest = collected
    records = P.page_records(P.read_manifest(spark, manifest).where("not torn"))
    write_page(tmp_path / "raw", 2, 4, [node("n9")])
    pages = P.read_pages(spark, pages_dir)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        good = P.good_pages(records.unionByName(records.where("page_index = 1")), pages)
        assert "Exchange hashpartitioning" not in plan_of(good)
        assert sorted((r.tier, r.page_index) for r in good.collect()) == [(1, 0), (1, 1), (1, 1), (2, 0)]
        status = P.page_status(records, pages)
        parsed = parsed_pages(pages)
        nodes = good_nodes(parsed, status)
        assert "Exchange hashpartitioning" not in plan_of(nodes)
        assert sorted((r.tier, r.page_index, r.position) for r in nodes.collect()) == [(1, 0, 0), (1, 0, 2), (1, 1, 0), (1, 1, 1), (2, 0, 0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_raw_pages_move_short_rows(spark, tmp_path):
    """Only columns of the tables are shuffled for a page, not its nodes; a repeat joins the page whose number it gets."""
    day = "timestamp'1996-02-03'"
    spark.sql("select 0L n_nationkey, 'NATION_1' n_name, 0L n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select 1L c_custkey, 0L c_nationkey, 'A' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql(f"select id o_orderkey, 1L o_custkey, 'F' o_orderstatus, 1.0D o_totalprice, {day} o_orderdate, '5-LOW' o_orderpriority"
              " from values (3L), (2L), (4500007L) t(id)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"select id l_orderkey, 5L l_partkey, 6L l_suppkey, 1L l_linenumber, 2.0D l_quantity, 0.06D l_discount, 0.01D l_tax, flag l_returnflag, 'O' l_linestatus,"
              f" {day} l_shipdate from values (2L, 'R'), (2L, 'A'), (4500007L, 'N') t(id, flag)").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = OrderTables(spark, str(tmp_path))
    folder, manifest = raw_pages.raw(t)
    pages, listed = P.read_pages(spark, folder, raw_pages.FOLDERS), P.read_manifest(spark, manifest).where("sha256 is not null")
    assert {r.status for r in P.page_status(listed, pages).collect()} == {"ok"} and pages.count() == listed.count() == 4
    got = P.page_nodes(P.good_pages(listed, pages)).select("tier", "page_index", "position", "node.number").collect()
    assert sorted(got) == [(1, 0, 0, 2), (1, 0, 1, 3), (1, 900, 0, 2), (1, 900, 1, 3), (1, 900, 2, 4500007), (2, 0, 0, 2), (2, 0, 1, 3), (2, 900, 0, 4500007)]
    moved = [line for line in plan_of(raw_pages._page_rows(t)).splitlines() if "Exchange hashpartitioning" in line]
    assert moved and "named_struct(id" not in plan_of(raw_pages._page_rows(t))


def test_orders_and_lines_are_dealt_to_their_page_at_once(spark, tmp_path):
    """Lines and orders are shuffled once each, whatever their size; of an order row that comes twice each meets both, with all lines."""
    day = "timestamp'1996-02-03'"
    spark.sql("select 0L n_nationkey, 'NATION_2' n_name, 0L n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    spark.sql("select 1L c_custkey, 0L c_nationkey, 'A' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.sql(f"select id o_orderkey, c o_custkey, 'F' o_orderstatus, 1.0D o_totalprice, {day} o_orderdate, p o_orderpriority"
              " from values (7L, 1L, 'x'), (7L, 9L, 'y'), (8L, 1L, 'z'), (null, 1L, 'z') t(id, c, p)").write.parquet(f"{tmp_path}/orders.parquet")
    spark.sql(f"select id l_orderkey, 5L l_partkey, 6L l_suppkey, 1L l_linenumber, 2.0D l_quantity, 0.06D l_discount, 0.01D l_tax, 'R' l_returnflag, 'O' l_linestatus,"
              f" {day} l_shipdate from values (7L), (null), (9L) t(id)").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = raw_pages._page_rows(OrderTables(spark, str(tmp_path)))
        moved = [line for line in plan_of(rows).splitlines() if "Exchange hashpartitioning" in line]
        assert sum("page_index" in m for m in moved) == 1 and not [m for m in moved if "orderkey" in m or "number" in m]
        page, = rows.collect()
        assert (page.project, page.page_index, page.tiers) == ("NATION_2", 0, [1, 2])
        assert [(o.number, o.o_orderpriority, o["items"] and len(o["items"])) for o in page.n] == [(7, "x", 2), (7, "y", 2), (8, "z", None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_earliest_moves_only_what_repeats(spark, tmp_path, monkeypatch):
    """Rows whose key comes once are not shuffled; null keys are keys, ties go to the least payload, with a long list of repeats as well."""
    given = [("p", 1, "a", 5, "x"), ("p", 1, "a", 2, "z"), ("p", 1, "a", 2, "y"), ("p", 2, "a", 9, "x"), (None, 1, "b", 3, "u"), (None, 1, "b", 1, "v"),
             ("p", 1, None, None, None)]
    rows = spark.createDataFrame(given, I.SCHEMA)
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.schema(I.SCHEMA).parquet(f"{tmp_path}/rows")
    want = {("p", 1, "a", 2, "y"), ("p", 2, "a", 9, "x"), (None, 1, "b", 1, "v"), ("p", 1, None, None, None)}
    got = I.earliest(rows)
    assert "LeftAnti" in plan_of(got) and "SortMergeJoin" not in plan_of(got)
    assert {tuple(r) for r in got.collect()} == want and got.count() == 4
    # What nobody asks for is not read for the rows that stay.
    assert "payload" not in plan_of(got.groupBy("project").agg(F.count("*"))).split("Union")[1].split("LeftAnti")[1].split("LeftSemi")[0].split("ReadSchema")[1]
    monkeypatch.setattr(I, "MOST_REPEATS", 1)
    assert {tuple(r) for r in I.earliest(rows).collect()} == want


def test_fields_that_are_left_out_change_no_row(spark, tmp_path):
    """Each entity's own fields give the rows of whole nodes, also where other values are of another type or missing."""
    odd = {"title": ["x"], "isDraft": "maybe", "reviews": {"totalCount": "60", "nodes": [{"id": {"a": 1}, "state": 3, "submittedAt": 5}, None, {}]},
           "comments": {"totalCount": 1, "nodes": [{"isMinimized": "no", "createdAt": "2025-01-02T00:00:00Z"}, {}]}, "labels": {"nodes": [None, {"name": "l"}]},
           "reviewThreads": {"totalCount": 2, "nodes": [{"id": "t", "isResolved": 1, "comments": {"totalCount": 12, "nodes": [{"id": "c"}, None]}}, {}]},
           "commits": {"totalCount": 1, "nodes": [{"commit": {"oid": 1, "authoredDate": "2024-12-31T00:00:00Z", "additions": "many", "deletions": 7}}, {"commit": None}]},
           "timelineItems": {"totalCount": 2, "nodes": [{"__typename": "A", "createdAt": "2025-01-03T00:00:00Z", "label": 4}, {"createdAt": "2025-01-02T00:00:00Z"}]}}
    given = [node("n1"), node("n2", **odd), node("n3", author={"login": 4, "databaseId": "z"}, number="no"), {**node("n4"), "id": None}, node("n5", reviews=[], commits=3)]
    for tier in (1, 2):
        write_page(tmp_path, tier, 0, given)
    pages = P.read_pages(spark, str(tmp_path))
    whole = lambda *names: {n: P.NODE_FIELDS[n] for n in names}
    entities = [
        (P.HISTORY_FIELDS, P.history_rows, 4), (P.SUBJECT_FIELDS, P.subject_rows, 4), (whole("reviews"), P.review_rows, 2), (whole("reviewThreads"), P.thread_comment_rows, 1),
        (whole("comments"), P.issue_comment_rows, 1), (whole("timelineItems"), P.timeline_rows, 2), (whole("commits"), P.commit_rows, 2),
        (P.RESPONSE_FIELDS, P.response_rows, 4), (P.CHECKED_FIELDS, P.order_violations, 1), (P.CHECKED_FIELDS, lambda n: n.select("node.id", P.truncated().alias("t")), 8),
        ({}, lambda n: n.select("tier", "node.id", "position"), 8)]
    for fields, rows, n in entities:
        assert len(P.page_schema(fields)) < len(P.PAGE_SCHEMA)
        want = sorted(map(str, rows(P.page_nodes(pages)).collect()))
        assert sorted(map(str, rows(P.page_nodes(pages, fields)).collect())) == want and len(want) >= n


def test_page_texts_are_hashed_once_and_only_what_is_asked_for_is_parsed(spark, collected, monkeypatch):
    pages_dir, manifest = collected
    made, real = {}, P.written
    monkeypatch.setattr(P, "written", lambda df, name: (made.__setitem__(name, plan_of(df)), real(df, name))[1])
    good = P.good_pages(P.page_records(P.read_manifest(spark, manifest).where("not torn")), P.read_pages(spark, pages_dir))
    assert "encode(" in made["digests"] and "encode(" not in made["other-pages"]
    first = P.first_nodes(P.page_nodes(good, {}))
    assert "createdAt" not in made["repeats"] and "createdAt" not in plan_of(first)
    assert sorted((r.tier, r.page_index, r.node.id) for r in first.collect()) == [(1, 0, "n1"), (1, 0, "n2"), (1, 1, "n3"), (2, 0, "n1")]


def test_folders_of_pages_are_listed_by_few_tasks(spark, tmp_path):
    for i in range(60):
        write_page(tmp_path, i, 0, [node("n1")])
    name, context = "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext
    before = spark.conf.get(name)
    context.setJobGroup("listing", "")
    try:
        pages = P.read_pages(spark, str(tmp_path))
    finally:
        context.setJobGroup("", "")
    tracker = context.statusTracker()
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) <= 4 * context.defaultParallelism < 60 and spark.conf.get(name) == before
    assert pages.count() == 60


def test_raw_pages_lie_side_by_side(spark, tmp_path):
    """One folder per page and no folders above it; a name with the separator is read back as it is."""
    import re
    assert [re.search(raw_pages.FOLDERS, f"/x/page={p}/part-0.txt.gz") and re.search(raw_pages.FOLDERS, f"/x/page={p}/part-0.txt.gz").groups()
            for p in ("NATION_1-2-30", "a-1-b-2-7", "a-1--7")] == [("NATION_1", "2", "30"), ("a-1-b", "2", "7"), None]
