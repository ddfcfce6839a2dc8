"""Splits and ranking metrics over the labelled points with a plain score."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens import schemas
from fleetlens.functions.timeutil import iso
from fleetlens.operators import metrics as ops
from fleetlens.operators import models as model_ops
from fleetlens.queries import views
from fleetlens.queries.registry import query
from fleetlens.queries.views import ISO, half_even, with_views
from fleetlens.session import materialize

_N_TRAIN = "greatest(1, CAST(round_even(0.7 * n, 0) AS BIGINT))"
_CUT = f"""o AS (SELECT ref, row_number() OVER (ORDER BY ref) - 1 AS i, count(*) OVER () AS n FROM scored),
 cut AS (SELECT min(ref) AS t_cut FROM o WHERE i = least({_N_TRAIN}, n - 1)),
 tst AS (SELECT * FROM scored WHERE ref >= (SELECT t_cut FROM cut))"""


def _test(spark, sf_dir):
    rows = ops.time_ordered_split(views.scored(spark, sf_dir))
    return rows.where(~F.col("is_train")).drop("is_train")


@query(
    "time_split",
    with_views(
        f"""WITH {_CUT} SELECT CAST(count(*) FILTER (WHERE ref < t_cut) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE ref >= t_cut) AS BIGINT) AS n_test,
        CAST(sum(label) FILTER (WHERE ref < t_cut) AS BIGINT) AS pos_train, CAST(sum(label) FILTER (WHERE ref >= t_cut) AS BIGINT) AS pos_test,
        strftime(make_timestamp(min(t_cut)), {ISO}) AS t_cut FROM scored, cut""",
        "scored",
    ),
)
def time_split(spark, sf_dir):
    """Sizes of the strict time-ordered split and its cut."""
    rows = views.scored(spark, sf_dir)
    cut = ops.time_cut(rows)
    return ops.time_ordered_split(rows).agg(
        F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_test"),
        F.sum(F.when(F.col("is_train"), F.col("label"))).cast("bigint").alias("pos_train"),
        F.sum(F.when(~F.col("is_train"), F.col("label"))).cast("bigint").alias("pos_test"),
        iso(cut.scalar()).alias("t_cut"),
    )


@query(
    "time_split_by_horizon",
    with_views(
        f"""WITH o AS (SELECT horizon_s, ref, row_number() OVER (PARTITION BY horizon_s ORDER BY ref) - 1 AS i, count(*) OVER (PARTITION BY horizon_s) AS n FROM scored),
        cut AS (SELECT horizon_s, min(ref) AS t_cut FROM o WHERE i = least({_N_TRAIN}, n - 1) GROUP BY 1)
        SELECT s.horizon_s, CAST(count(*) FILTER (WHERE ref < t_cut) AS BIGINT) AS n_train, CAST(count(*) FILTER (WHERE ref >= t_cut) AS BIGINT) AS n_test
        FROM scored s JOIN cut c ON c.horizon_s = s.horizon_s GROUP BY 1""",
        "scored",
    ),
)
def time_split_by_horizon(spark, sf_dir):
    rows = ops.time_ordered_split(views.scored(spark, sf_dir), keys=["horizon_s"])
    return rows.groupBy("horizon_s").agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test"))


_RANK = """rk AS (SELECT *, rank() OVER ({part} ORDER BY score) + (count(*) OVER ({pcomma} score) - 1) / 2.0::DOUBLE AS ar FROM tst),
 ap0 AS (SELECT {key} score, count(*) AS n, sum(label) AS p FROM tst GROUP BY {key} score),
 ap1 AS (SELECT *, sum(n) OVER ({part} ORDER BY score DESC) AS cn, sum(p) OVER ({part} ORDER BY score DESC) AS cp, sum(p) OVER ({part}) AS tp FROM ap0),
 ap AS (SELECT {key} sum(p * cp / cn::DOUBLE) / max(tp) AS v FROM ap1 {grp})"""
_ALL = _RANK.format(part="", pcomma="PARTITION BY", key="", grp="")
_PER = _RANK.format(part="PARTITION BY horizon_s", pcomma="PARTITION BY horizon_s,", key="horizon_s,", grp="GROUP BY horizon_s")
_AUC = "(sum(ar) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE) / (sum(label) * (count(*) - sum(label)))"


@query(
    "ranking_metrics",
    with_views(
        f"WITH {_CUT}, {_ALL} SELECT count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, round({_AUC}, 9) AS roc_auc, (SELECT round(v, 9) FROM ap) AS avg_precision FROM rk", "scored"
    ),
)
def ranking_metrics(spark, sf_dir):
    """ROC-AUC and step average precision on the held-out side, ties shared."""
    out = ops.ranking_metrics(_test(spark, sf_dir))
    return out.withColumn("roc_auc", F.round("roc_auc", 9)).withColumn("avg_precision", F.round("avg_precision", 9))


@query(
    "ranking_metrics_by_horizon",
    with_views(
        f"""WITH {_CUT}, {_PER}, a AS (SELECT horizon_s, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos, round({_AUC}, 9) AS roc_auc FROM rk GROUP BY horizon_s)
        SELECT a.horizon_s, n, pos, roc_auc, round(ap.v, 9) AS avg_precision FROM a JOIN ap ON ap.horizon_s = a.horizon_s""",
        "scored",
    ),
)
def ranking_metrics_by_horizon(spark, sf_dir):
    out = ops.ranking_metrics(_test(spark, sf_dir), keys=["horizon_s"])
    return out.withColumn("roc_auc", F.round("roc_auc", 9)).withColumn("avg_precision", F.round("avg_precision", 9))


def _budget_sql(key: str) -> str:
    part = f"PARTITION BY {key}" if key else ""
    sel = f"{key}," if key else ""
    on = f"b.{key} = r.{key} AND " if key else ""
    grp = f"GROUP BY {key}" if key else ""
    return f"""r AS (SELECT *, row_number() OVER ({part} ORDER BY score DESC, tie) AS rnk FROM tst),
 b AS (SELECT {sel} count(*) AS n, sum(label) AS pos FROM tst {grp}),
 k AS (SELECT b.*, u.budget, greatest(1, CAST({half_even('b.n * u.budget', 0)} AS BIGINT)) AS k FROM b, (SELECT unnest([0.01, 0.05, 0.10]::DOUBLE[]) AS budget) u),
 res AS (SELECT {f'b.{key},' if key else ''} b.budget, b.k, CAST(sum(r.label) AS BIGINT) AS flagged_positive, round(sum(r.label) / b.k::DOUBLE, 9) AS precision,
   round(CASE WHEN b.pos > 0 THEN sum(r.label) / b.pos::DOUBLE END, 9) AS recall FROM k b JOIN r ON {on} r.rnk <= b.k GROUP BY {f'b.{key},' if key else ''} b.budget, b.k, b.pos)"""


def _rounded(df):
    return df.withColumn("precision", F.round("precision", 9)).withColumn("recall", F.round("recall", 9))


@query("alert_budgets", with_views(f"WITH {_CUT}, {_budget_sql('')} SELECT * FROM res", "scored"))
def alert_budgets(spark, sf_dir):
    """Precision and recall when exactly the top 1, 5 and 10 % are alerted."""
    return _rounded(ops.alert_budgets(_test(spark, sf_dir)))


@query("alert_budgets_by_horizon", with_views(f"WITH {_CUT}, {_budget_sql('horizon_s')} SELECT * FROM res", "scored"))
def alert_budgets_by_horizon(spark, sf_dir):
    return _rounded(ops.alert_budgets(_test(spark, sf_dir), keys=["horizon_s"]))


@query(
    "best_budget",
    with_views(
        f"WITH {_CUT}, {_budget_sql('')} SELECT budget, precision AS best_precision, recall AS best_recall FROM res ORDER BY precision DESC, budget LIMIT 1", "scored"
    ),
)
def best_budget(spark, sf_dir):
    return ops.best_budget(_rounded(ops.alert_budgets(_test(spark, sf_dir))))


@query(
    "top_flags",
    with_views(
        f"""WITH {_CUT}, f AS (SELECT *, row_number() OVER (ORDER BY score DESC, tie) AS rnk, count(*) OVER () AS n FROM tst)
        SELECT gpu, strftime(make_timestamp(ref), {ISO}) AS t_ref, horizon_s, score, rnk AS rank FROM f WHERE rnk <= greatest(1, CAST({half_even('n * 0.05::DOUBLE', 0)} AS BIGINT))""",
        "scored",
    ),
)
def top_flags(spark, sf_dir):
    """The rows alerted at a 5 % budget."""
    rows = ops.flag_top(_test(spark, sf_dir).select("gpu", "t_ref", "horizon_s", "label", "score"), 0.05).where("flagged")
    return rows.select("gpu", iso("t_ref").alias("t_ref"), "horizon_s", "score", "rank")


_FEATS = [f"{m}_{s}" for m in views.FEATURE_METRICS for s in ("count", "last", "max", "min", "present")]
_UNPIVOT = " UNION ALL ".join(f"SELECT '{f}' AS feature, label, CAST({f} AS DOUBLE) AS v FROM tst" for f in _FEATS)
_FAUC = f"""lng AS ({_UNPIVOT}), md AS (SELECT feature, median(v) AS m FROM lng GROUP BY 1),
 fl AS (SELECT l.feature, l.label, coalesce(l.v, md.m) AS score FROM lng l JOIN md USING (feature) WHERE md.m IS NOT NULL),
 rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY score) + (count(*) OVER (PARTITION BY feature, score) - 1) / 2.0::DOUBLE AS ar FROM fl),
 fa AS (SELECT feature, round({_AUC}, 9) AS auc FROM rk GROUP BY feature)"""


def _feature_auc(spark, sf_dir):
    out = ops.single_feature_auc(_test(spark, sf_dir), _FEATS)
    return out.withColumn("auc", F.round("auc", 9))


@query("single_feature_auc", with_views(f"WITH {_CUT}, {_FAUC} SELECT * FROM fa", "scored"))
def single_feature_auc(spark, sf_dir):
    """Held-out AUC of each raw feature on its own."""
    return _feature_auc(spark, sf_dir)


@query(
    "leakage_probe",
    with_views(
        f"""WITH {_CUT}, {_FAUC} SELECT CAST(0.5 AS DOUBLE) AS shuffled_label_auc, round(max(abs(auc - 0.5) + 0.5), 9) AS max_single_feature_auc,
        max(abs(auc - 0.5) + 0.5) > 0.99 AS leaks FROM fa""",
        "scored",
    ),
)
def leakage_probe(spark, sf_dir):
    out = ops.leakage_probe(_feature_auc(spark, sf_dir), 0.5)
    return out.withColumn("max_single_feature_auc", F.round("max_single_feature_auc", 9))


@query(
    "feature_ranking",
    with_views(f"WITH {_CUT}, {_FAUC} SELECT feature, auc, row_number() OVER (ORDER BY round(abs(auc - 0.5), 9) DESC, feature) AS place FROM fa", "scored"),
)
def feature_ranking(spark, sf_dir):
    """Features by distance of their AUC from chance."""
    from pyspark.sql import Window

    # twenty rows: one per feature
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs(F.col("auc") - 0.5), 9)), "feature"))
    return ops.feature_ranking(_feature_auc(spark, sf_dir)).withColumn("place", place.cast("bigint"))


_MERGED = f"""lng AS (SELECT horizon_s, feature, label, v FROM (
  {" UNION ALL ".join(f"SELECT horizon_s, '{f}' AS feature, label, CAST({f} AS DOUBLE) AS v FROM tst" for f in _FEATS)})),
 md AS (SELECT horizon_s, feature, median(v) AS m FROM lng GROUP BY 1, 2),
 fl AS (SELECT l.horizon_s, l.feature, l.label, coalesce(l.v, md.m) AS score FROM lng l JOIN md USING (horizon_s, feature) WHERE md.m IS NOT NULL),
 rk AS (SELECT *, rank() OVER (PARTITION BY horizon_s, feature ORDER BY score) + (count(*) OVER (PARTITION BY horizon_s, feature, score) - 1) / 2.0::DOUBLE AS ar FROM fl),
 fa AS (SELECT horizon_s, feature, round({_AUC}, 9) AS auc FROM rk GROUP BY 1, 2)"""


@query(
    "merged_ranking",
    with_views(f"WITH {_CUT}, {_MERGED} SELECT feature, round(max(abs(auc - 0.5)), 9) AS separation FROM fa GROUP BY feature", "scored"),
)
def merged_ranking(spark, sf_dir):
    """Each feature's most separating AUC over three rounds (one per horizon)."""
    test = _test(spark, sf_dir)
    rounds = None
    for h in views.HORIZONS_S:
        part = ops.single_feature_auc(test.where(F.col("horizon_s") == h), _FEATS).withColumn("auc", F.round("auc", 9))
        rounds = part if rounds is None else rounds.unionByName(part)
    return ops.merge_rankings(rounds).select("feature", F.round(F.abs(F.col("auc") - 0.5), 9).alias("separation"))


_KEY = "gpu || '|' || node || '|' || gpu_idx || '|' || ref || '|' || CAST(horizon_s AS BIGINT) || '|' || label"


@query(
    "holdout_identity",
    with_views(
        f"""WITH {_CUT}, d AS (SELECT sha256({_KEY}) AS d FROM tst),
        g AS (SELECT substr(d, 1, 3) AS g, sha256(string_agg(d, chr(10) ORDER BY d)) AS gd FROM d GROUP BY 1)
        SELECT sha256('gpu,node,gpu_idx,t_ref,horizon_s,label' || chr(10) || string_agg(g || ':' || gd, chr(10) ORDER BY g)) AS holdout_id FROM g""",
        "scored",
    ),
)
def holdout_identity(spark, sf_dir):
    return ops.holdout_identity(_test(spark, sf_dir))


@query(
    "no_skill_baseline",
    with_views(
        f"""WITH {_CUT} SELECT CAST(0.5 AS DOUBLE) AS roc_auc, round(avg(label) FILTER (WHERE ref >= t_cut), 9) AS avg_precision, round(avg(label) FILTER (WHERE ref >= t_cut), 9) AS base_rate,
        round(avg(label) FILTER (WHERE ref < t_cut), 9) AS constant_score, count(*) FILTER (WHERE ref < t_cut) AS n_train, count(*) FILTER (WHERE ref >= t_cut) AS n_test FROM scored, cut""",
        "scored",
    ),
)
def no_skill_baseline(spark, sf_dir):
    out = ops.no_skill_baseline(ops.time_ordered_split(views.scored(spark, sf_dir)))
    for c in ("avg_precision", "base_rate", "constant_score"):
        out = out.withColumn(c, F.round(c, 9))
    return out


# --- all feature columns ------------------------------------------------------------------
# The twins above name half of the window statistics; these queries take every one and have no twin.


def _all_features(spark, sf_dir):
    return schemas.feature_columns(views.points(spark, sf_dir).columns)


def _full_auc(test, features):
    return ops.single_feature_auc(test, features).withColumn("auc", F.round("auc", 9))


@query("full_feature_auc")
def full_feature_auc(spark, sf_dir):
    """Held-out AUC of every feature of the points on its own."""
    return _full_auc(_test(spark, sf_dir), _all_features(spark, sf_dir))


@query("full_feature_ranking")
def full_feature_ranking(spark, sf_dir):
    """All features by distance of their AUC from chance."""
    from pyspark.sql import Window

    # one row per feature
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.round(F.abs(F.col("auc") - 0.5), 9)), "feature"))
    return ops.feature_ranking(full_feature_auc(spark, sf_dir)).withColumn("place", place.cast("bigint"))


@query("full_merged_ranking")
def full_merged_ranking(spark, sf_dir):
    """Every feature's most separating AUC over one round per horizon."""
    test, features = _test(spark, sf_dir), _all_features(spark, sf_dir)
    rounds = None
    for h in views.HORIZONS_S:
        part = _full_auc(test.where(F.col("horizon_s") == h), features)
        rounds = part if rounds is None else rounds.unionByName(part)
    return ops.merge_rankings(rounds).select("feature", F.round(F.abs(F.col("auc") - 0.5), 9).alias("separation"))


@query("full_leakage_probe")
def full_leakage_probe(spark, sf_dir):
    """Both leak guards: the strongest of all features alone, and a logistic model over all of them on permuted labels."""
    features = tuple(_all_features(spark, sf_dir))
    rows = materialize(ops.time_ordered_split(views.points(spark, sf_dir)), "split")  # read many times below
    early, late = rows.where("is_train").drop("is_train"), rows.where("NOT is_train").drop("is_train")
    permuted = model_ops.permuted_auc(early, late, model_ops.Candidate("logreg", features))
    out = ops.leakage_probe(_full_auc(late, features), permuted)
    return out.withColumn("max_single_feature_auc", F.round("max_single_feature_auc", 9))
