"""The given tables seen as subjects, responses, timelines and predictions.

Binding T reads orders as subjects (day-granular times, many ties) and line items as responses,
state events and commits.  Binding E reads sign-up events as subjects (microsecond times) and later
purchases of the same user as responses.  Each function returns one entity DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waitline.conf import Settings, utc
from waitline.session import use_utc, written

SETTINGS_T = Settings(
    threshold_h=360 * 24.0, censor_h=1080 * 24.0, trailing_days=720,
    window_start=utc("1996-01-01T00:00:00"), window_end=utc("2000-12-31T23:59:59"),
    cutoff=utc("2000-01-01T00:00:00"),
)
SETTINGS_E = Settings(
    threshold_h=24.0, censor_h=168.0, trailing_days=7, recent_days=1,
    window_start=utc("2024-01-03T00:00:00"), window_end=utc("2024-01-28T23:59:59"),
    cutoff=utc("2024-01-20T00:00:00"), bucket_days=1,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{sf_dir}/{name}.parquet")


_SHARED: dict = {}


def shared(kind):
    """Write a table several queries start from, once per session and directory.

    Labels, features and predictions are tables in their own right; writing them also keeps the
    plans built on top of them short.
    """

    def wrap(fn):
        def get(self):
            key = (self.spark.sparkContext.applicationId, self.dir, kind)
            if key not in _SHARED:
                _SHARED[key] = written(fn(self), kind)
            return _SHARED[key]

        return get

    return wrap


def forget_shared(keep: tuple[str, ...] = ()) -> None:
    """Make the next query write its starting tables anew, all but the kinds in ``keep``."""
    for key in [k for k in _SHARED if k[2] not in keep]:
        del _SHARED[key]


class OrderTables:
    """Binding T."""

    settings = SETTINGS_T

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir

    def _t(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def _orders(self) -> DataFrame:
        places = self._t("nation").select("n_nationkey", F.col("n_name").alias("project"))
        buyers = self._t("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(
            "c_custkey", "project", "c_mktsegment"
        )
        return self._t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"))

    def history(self) -> DataFrame:
        return self._orders().selectExpr(
            "project",
            "cast(o_orderkey as string) as id",
            "o_orderkey as number",
            "cast(o_orderdate as timestamp) as created_at",
            "case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) + interval 30 days end as closed_at",
            "case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) + interval 30 days end as merged_at",
            "case when o_custkey % 37 <> 0 then concat('c', o_custkey) end as actor_login",
            "case when o_custkey % 37 = 0 then null when o_custkey % 20 = 0 then 'Bot' else 'User' end as actor_type",
            "case when o_custkey % 37 = 0 then null else o_custkey % 20 = 0 end as actor_is_bot",
            "case when o_custkey % 3 = 0 then 'CONTRIBUTOR' when o_custkey % 7 = 0 then null else 'NONE' end as association_current",
        )

    def subjects(self) -> DataFrame:
        return self._orders().selectExpr(
            "project",
            "cast(o_orderkey as string) as id",
            "o_orderkey as number",
            "concat('https://example.com/', project, '/', o_orderkey) as url",
            "cast(o_orderdate as timestamp) as created_at",
            "case when o_orderstatus = 'F' then cast(o_orderdate as timestamp) + interval 30 days end as closed_at",
            "case when o_orderstatus = 'F' and o_orderkey % 2 = 0 then cast(o_orderdate as timestamp) + interval 30 days end as merged_at",
            "case when o_custkey % 37 <> 0 then concat('c', o_custkey) end as actor_login",
            "case when o_custkey % 37 = 0 then null else o_custkey % 20 = 0 end as actor_is_bot",
            "case when o_custkey % 37 <> 0 then timestamp'1990-01-01' + make_dt_interval(cast(o_custkey % 3000 as int)) end as actor_created_at",
            "case when o_orderpriority = '1-URGENT' then null else o_orderpriority = '5-LOW' end as is_cross",
            "o_orderstatus = 'P' as is_draft_current",
            "concat('Order ', o_orderkey, ' ', o_orderpriority) as title_current",
            "case when o_orderpriority <> '4-NOT SPECIFIED' then concat(c_mktsegment, ' ', o_totalprice > 250000) end as body_current",
            "o_orderstatus as base_ref_current",
            "cast(o_orderkey % 4 as int) as n_labels_current",
            "case when o_totalprice > 250000 then cast(o_orderdate as timestamp) + interval 1 day end as last_edited_at",
            "o_totalprice",
        )

    def _lines(self) -> DataFrame:
        return self._t("lineitem").join(
            self._t("orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("opened")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )

    def _lines_by_id(self) -> DataFrame:
        """``_lines`` joined on the subject's ``id``, by which what follows groups and joins: lines are shuffled once."""
        opened = self._t("orders").select(
            F.col("o_orderkey").cast("string").alias("_id"), "o_custkey", F.col("o_orderdate").cast("timestamp").alias("opened"))
        return self._t("lineitem").withColumn("id", F.col("l_orderkey").cast("string")).join(opened, F.col("id") == F.col("_id")).drop("_id")

    def responses(self) -> DataFrame:
        late = self._lines_by_id().where(F.col("l_shipdate").cast("timestamp") >= F.col("opened"))
        return late.selectExpr(
            "id",
            "case l_returnflag when 'R' then 'reviews' when 'A' then 'thread_comments' else 'issue_comments' end as stream",
            "cast(l_shipdate as timestamp) - interval 1 hour as created_at",
            "case when l_tax < 0.08 then cast(l_shipdate as timestamp) end as submitted_at",
            "case when l_tax > 0 then cast(l_shipdate as timestamp) end as published_at",
            "case when l_suppkey % 17 = 0 then null when l_linenumber = 7 then concat('c', o_custkey)"
            " when l_suppkey % 13 = 0 then 'Renovate' else concat('s', l_suppkey) end as login",
            "case when l_suppkey % 10 = 0 then 'Bot' else 'User' end as type",
            "case when l_linenumber = 6 then null when l_linestatus = 'O' then 'MEMBER' else 'NONE' end as association",
            "case when l_linenumber = 5 then null else l_discount > 0.09 end as is_minimized",
        )

    def timeline(self) -> DataFrame:
        return self._lines_by_id().selectExpr(
            "id",
            "case l_linenumber when 1 then 'ReadyForReviewEvent' when 2 then 'ConvertToDraftEvent'"
            " when 3 then 'LabeledEvent' when 4 then 'UnlabeledEvent' when 5 then 'RenamedTitleEvent'"
            " when 6 then 'BaseRefChangedEvent' else 'ReviewRequestedEvent' end as event_type",
            "case when l_linenumber = 7 then opened + make_dt_interval(0, 0, 0, cast(l_suppkey % 120 as int))"
            " else cast(l_shipdate as timestamp) end as created_at",
            "concat_ws('-', l_partkey, l_suppkey) as event_key",
            "case when l_linenumber = 5 and l_suppkey % 5 <> 0 then concat('was ', l_partkey) end as previous_title",
            "case when l_linenumber = 6 and l_suppkey % 5 <> 0 then substr('OFP', cast(l_partkey % 3 as int) + 1, 1) end as previous_ref",
            "case when l_linenumber = 7 then if(l_partkey % 2 = 0, 'Team', 'User') end as requested_type",
        )

    def commits(self) -> DataFrame:
        return self._t("lineitem").selectExpr(
            "cast(l_orderkey as string) as id",
            "cast(l_shipdate as timestamp) as authored_date",
            "case when l_linenumber <> 4 then cast(l_quantity as bigint) end as additions",
            "l_partkey % 50 as deletions",
        )

    def project_meta(self) -> DataFrame:
        makers = self._t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("makers"))
        buyers = self._t("customer").groupBy("c_nationkey").agg(F.count("*").alias("buyers"))
        return (
            self._t("nation")
            .join(self._t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .join(makers, F.col("n_nationkey") == F.col("s_nationkey"), "left")
            .join(buyers, F.col("n_nationkey") == F.col("c_nationkey"), "left")
            .selectExpr(
                "n_name as project",
                "timestamp'1990-01-01' + make_dt_interval(n_nationkey * 30) as created_at",
                "if(n_nationkey % 2 = 0, 'Organization', 'User') as owner_type",
                "r_name as language_dominant",
                "if(n_nationkey % 3 = 0, 'F', 'O') as default_branch",
                "coalesce(makers, 0) as n_assignable_users",
                "coalesce(buyers, 0) as n_mentionable_users",
                "n_nationkey % 2 = 1 as has_codeowners",
                "n_nationkey % 3 = 1 as has_pr_template",
                "n_nationkey % 5 = 1 as has_contributing",
                "n_nationkey % 7 as n_ci_workflows",
            )
        )

    def cohort(self) -> DataFrame:
        """One row per project: its stratum and size tier."""
        return self._t("nation").join(self._t("region"), F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
            "n_name as project",
            "if(n_nationkey % 6 = 5, 'ASIA', r_name) as language_stratum",
            "concat('tier', n_nationkey % 3) as size_tier",
        )

    def kept(self) -> DataFrame:
        """Projects that stay in the study (all but those of one nation key class)."""
        return self._t("nation").where(F.col("n_nationkey") % 8 != 7).select(F.col("n_name").alias("project"))

    def manifest(self) -> DataFrame:
        """Order rows as page records: pages, give-ups, bypass notes and error pages."""
        return self._orders().selectExpr(
            "project", "cast(o_orderkey % 3 as int) as tier", "o_orderkey as page_index",
            "if(o_custkey % 9 = 0, null, concat('k', o_custkey % 200)) as cursor_before",
            "if(o_orderpriority = '1-URGENT', 'timeout', null) as fatal_transient",
            "o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0 as bypass",
            "if(o_orderpriority = '2-HIGH' and o_orderkey % 5 = 0, array(o_custkey, o_custkey % 10), null) as dead_numbers",
            "if(o_orderkey % 11 = 0, null, o_orderpriority = '3-MEDIUM' and o_orderkey % 7 = 0) as has_graphql_errors",
            "if(o_orderkey % 4 = 0, 'v2', 'v1') as query_version",
            "o_custkey % 50 as pr_count", "if(o_orderkey % 6 = 0, null, o_orderkey % 8) as rate_limit_cost",
            "cast(o_totalprice as bigint) as bytes",
        )

    def candidates(self) -> DataFrame:
        """Customers as candidate projects: languages sized by the quantity per return flag."""
        sizes = self._lines().groupBy("o_custkey", F.col("l_returnflag").alias("name")).agg(
            F.sum("l_quantity").cast("long").alias("size"))
        # At most three flags per customer.
        langs = sizes.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("languages"))
        volume = self._t("orders").groupBy(F.col("o_custkey").alias("_c")).agg(
            F.count("*").alias("n_all"), F.count_if(F.col("o_orderdate").cast("timestamp") >= F.lit("1998-01-01").cast("timestamp")).alias("n_window"),
            F.max(F.col("o_orderdate").cast("timestamp")).alias("pushed_at"))
        c = self._t("customer").join(langs, F.col("c_custkey") == F.col("o_custkey"), "left").join(
            volume, F.col("c_custkey") == F.col("_c"), "left")
        return c.selectExpr(
            "cast(c_custkey as string) as id", "c_mktsegment as primary_language", "languages",
            "cast(c_acctbal as bigint) as stars", "pushed_at", "coalesce(n_all, 0) as n_all", "coalesce(n_window, 0) as n_window",
            "c_custkey % 10 = 0 as is_fork", "if(c_custkey % 4 = 0, null, c_custkey % 11 = 0) as is_archived",
            "c_custkey % 13 = 0 as is_mirror", "c_custkey % 17 = 0 as is_private",
            "concat(c_mktsegment, ':', case when c_acctbal < 2000 then 'low' when c_acctbal < 6000 then 'mid' else 'high' end) as cell",
        )

    @shared("labels")
    def labels(self) -> DataFrame:
        """Primary labels of the modelling rows."""
        from waitline.operators.labels import label, modelling_rows

        return label(modelling_rows(self.subjects(), self.settings), self.responses(), self.settings)

    @shared("features")
    def feature_table(self) -> DataFrame:
        from waitline.operators import atopen, features

        rows = self.subjects()
        return features.build(
            rows, self.history(), self.responses(), self.timeline(), atopen.commits_at_open(rows, self.commits()),
            self.project_meta(), self.kept(), self.settings,
        )

    @shared("predictions")
    def predictions(self) -> DataFrame:
        """Scored modelling rows: outcome by the primary definition, two scores from order columns."""
        from waitline.operators.labels import modelling_rows

        marks = self.labels().select("id", "is_slow", "wait_h", "first_event_at")
        return modelling_rows(self.subjects(), self.settings).join(marks, "id").selectExpr(
            "id", "project", "number", "created_at", "closed_at", "url", "title_current as title", "is_slow",
            "wait_h", "first_event_at as first_response_at",
            "least(0.999D, greatest(0.001D, floor(o_totalprice / 500) / 1000.0D)) as p_hat",
            "(number % 97 + 1) / 100.0D as baseline_score",
            "coalesce(actor_login, '') < 'c5' as is_first_here",
            "cast(number % 24 as int) as created_hour",
            "number % 5 = 0 as diff_is_exact",
        )

    def scenarios(self) -> DataFrame:
        """Test rows of both scenarios: A after the cutoff, B each project in its own fold."""
        from waitline.functions.columns import instant
        from waitline.operators.splits import group_folds

        p = self.predictions()
        a = p.where(F.col("created_at") >= instant(self.settings.cutoff)).withColumns(
            {"scenario": F.lit("A"), "fold": F.lit(0).cast("long")})
        b = p.join(group_folds(p, 5).select("project", "fold"), "project").withColumn("scenario", F.lit("B"))
        return a.unionByName(b)

    @shared("scored")
    def scored(self) -> DataFrame:
        """The scenario rows once per feature set, each set with its own score."""
        sets = {
            "FULL": "p_hat", "NO_SNAPSHOT": "p_hat * 0.5D + diff_is_exact_d * 0.1D",
            "NO_LABEL_REPLAY": "p_hat * 0.5D + baseline_score * 0.25D", "SUBJECT_ONLY": "created_hour / 25.0D",
        }
        base = self.scenarios().withColumn("diff_is_exact_d", F.col("diff_is_exact").cast("double"))
        cells = ", ".join(f"'{k}', {v}" for k, v in sets.items())
        keep = [c for c in base.columns if c not in ("p_hat", "diff_is_exact_d")]
        return base.selectExpr(*keep, f"stack({len(sets)}, {cells}) as (featureset, p_hat)")


class EventTables:
    """Binding E."""

    settings = SETTINGS_E

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir

    def _events(self) -> DataFrame:
        return table(self.spark, self.dir, "events").withColumn("at", F.col("ts").cast("timestamp"))

    def subjects(self) -> DataFrame:
        return self._events().where("event_type = 'signup'").selectExpr(
            "concat('p', user_id % 25) as project",
            "cast(event_id as string) as id",
            "event_id as number",
            "at as created_at",
            "case when value > 20 then at + interval 36 hours end as closed_at",
            "case when value > 40 then at + interval 36 hours end as merged_at",
            "concat('u', user_id) as actor_login",
            "user_id % 20 = 0 as actor_is_bot",
        )

    history = subjects

    def responses(self) -> DataFrame:
        opened = self.subjects().select("id", F.expr("cast(substr(actor_login, 2) as bigint)").alias("user_id"), "created_at")
        bought = self._events().where("event_type = 'purchase'").select("user_id", "event_id", "at")
        # Equality on the user bounds the pairing; the time condition is applied in the same join.
        return opened.join(bought, "user_id").where(F.col("at") > F.col("created_at")).selectExpr(
            "id",
            "case event_id % 3 when 0 then 'reviews' when 1 then 'thread_comments' else 'issue_comments' end as stream",
            "at as created_at", "at as submitted_at", "at as published_at",
            "concat('svc', event_id % 7) as login", "'User' as type",
            "if(event_id % 4 = 0, 'NONE', 'MEMBER') as association",
            "event_id % 11 = 0 as is_minimized",
        )


class DocumentTables:
    """Labelled documents as predictions: quality is the outcome, length the score."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir

    def predictions(self) -> DataFrame:
        return table(self.spark, self.dir, "documents").join(table(self.spark, self.dir, "labels"), "doc_id").selectExpr(
            "cast(doc_id as string) as id", "source as project", "quality = 1 as is_slow",
            "cast(n_chars as double) as p_hat", "lang",
        )


class EmbeddingTables:
    """Vectors as an attribution matrix: one row per vector, its label as the group."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = use_utc(spark), sf_dir

    def attributions(self) -> DataFrame:
        return table(self.spark, self.dir, "embeddings").selectExpr(
            "cast(vec_id as string) as id", "concat('g', label) as project",
            "transform(embedding, x -> cast(x as double)) as contributions",
        )
