"""Evaluation metrics computed on Spark: splits, ranking metrics, alert budgets, leak probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.intervals import micros
from fleetlens.plans.scan import (
    exact_medians,
    order_statistics,
    ordered_scan,
    tie_key,
)
from fleetlens.session import materialize

TRAIN_FRACTION = 0.70
ALERT_BUDGETS = (0.01, 0.05, 0.10)
ROW_KEY = ("gpu", "t_ref", "horizon_s")
# What counts as a leak.
SHUFFLED_AUC_LIMIT = 0.65
FEATURE_AUC_LIMIT = 0.99


def time_cut(points: DataFrame, train_frac: float = TRAIN_FRACTION, *, keys: Sequence[str] = (), **kw) -> DataFrame:
    """The ``t_ref`` of the first test row in time order (per key)."""
    k = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(train_frac)).cast("bigint"))
    index = F.least(k, F.col("_n") - 1)
    timed = points.select(*keys, micros("t_ref").alias("_pos"))
    cut = order_statistics(timed, "_pos", {"_cut": index}, keys=keys, **kw)
    return cut.select(*keys, F.timestamp_micros("_cut").alias("t_cut"))


def time_ordered_split(points: DataFrame, train_frac: float = TRAIN_FRACTION, *, keys: Sequence[str] = (), **kw) -> DataFrame:
    """Add ``is_train``: strictly before the cut; rows at the cut time go to test."""
    cut = time_cut(points, train_frac, keys=keys, **kw)
    if keys:
        placed = points.join(F.broadcast(cut), list(keys))  # one row per horizon
    else:
        placed = points.withColumn("t_cut", cut.scalar())
    return placed.withColumn("is_train", F.col("t_ref") < F.col("t_cut")).drop("t_cut")


def row_order_split(rows: DataFrame, order: str, val_frac: float = 0.3, *, at_least_one: bool = False, **kw) -> DataFrame:
    """Add ``is_train`` for the first ``int(n·(1-val_frac))`` rows by the unique number ``order``."""
    n_train = F.floor(F.col("_n") * F.lit(1 - val_frac))
    if at_least_one:
        n_train = F.greatest(F.lit(1), n_train)
    # first row of the validation side; an index past the end finds no such row
    start = order_statistics(rows.select(order), order, {"_start": n_train}, **kw).select("_start").scalar()
    return rows.withColumn("is_train", F.coalesce(F.col(order) < start, F.lit(True)))


def ranking_metrics(scored: DataFrame, *, keys: Sequence[str] = (), score: str = "score", **kw) -> DataFrame:
    """Per key: rows, positives, ROC-AUC and step average precision (NULL for a single class).

    Tied scores share an average rank and one precision step. Rows are counted per score
    first, so a score shared by many rows costs one row.
    """
    counts = (
        scored.where(F.col(score).isNotNull())
        .groupBy(*keys, F.col(score).alias("_s"))
        .agg(F.count("*").alias("_n"), F.sum(F.col("label").cast("bigint")).alias("_p"))
    )
    return _ranking_of_counts(counts, list(keys), **kw)


def _ranking_of_counts(counts: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Ranking metrics from rows ``_n`` and positives ``_p`` per score ``_s``."""
    scanned = ordered_scan(counts, "_s", {"_cn": ("sum", "_n"), "_cp": ("sum", "_p")}, keys=keys, **kw)
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum("_p").alias("pos"))
    if keys:
        full = scanned.join(F.broadcast(totals), keys)  # one row per key of a short list
    else:
        full = scanned.withColumn("n", totals.select("n").scalar()).withColumn("pos", totals.select("pos").scalar())
    mean_rank = (F.col("_cn") - F.col("_n")) + (F.col("_n") + 1) / 2.0
    at_or_above = F.col("n") - (F.col("_cn") - F.col("_n"))
    hits_above = F.col("pos") - (F.col("_cp") - F.col("_p"))
    sums = full.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.max("pos").alias("pos"),
        F.sum(F.col("_p") * mean_rank).alias("_ranks"),
        F.sum(F.col("_p") * (hits_above / at_or_above)).alias("_steps"),
    )
    neg = F.col("n") - F.col("pos")
    both = (F.col("pos") > 0) & (neg > 0)
    return sums.select(
        *keys,
        "n",
        "pos",
        F.when(both, (F.col("_ranks") - F.col("pos") * (F.col("pos") + 1) / 2.0) / (F.col("pos") * neg)).alias("roc_auc"),
        F.when(both, F.col("_steps") / F.col("pos")).alias("avg_precision"),
    )


def budget_size(n: Column, budget: Column) -> Column:
    """``max(1, round(budget·n))``, halves to even."""
    return F.greatest(F.lit(1).cast("bigint"), F.bround(n * budget).cast("bigint"))


def ranked_by_score(scored: DataFrame, *, keys: Sequence[str] = (), score: str = "score", row_key: Sequence[str] = ROW_KEY, **kw) -> DataFrame:
    """Add ``rank`` (1 = highest score, ties by a hash of the row key) and ``hits`` up to that rank."""
    rows = (
        scored.where(F.col(score).isNotNull())
        .withColumn("_neg", -F.col(score))
        .withColumn("_tie", tie_key(*row_key_columns(row_key)))
        .withColumn("_one", F.lit(1).cast("bigint"))
        .withColumn("_hit", F.col("label").cast("bigint"))
    )
    ranked = ordered_scan(rows, "_neg", {"rank": ("sum", "_one"), "hits": ("sum", "_hit")}, keys=keys, tie="_tie", **kw)
    return ranked.drop("_neg", "_tie", "_one", "_hit")


def row_key_columns(row_key: Sequence[str] = ROW_KEY) -> list[Column]:
    """Row identity as text parts: times in microseconds, horizons as whole seconds."""
    parts = []
    for c in row_key:
        if c == "t_ref":
            parts.append(F.unix_micros(c).cast("string"))
        elif c == "horizon_s":
            parts.append(F.col(c).cast("bigint").cast("string"))
        else:
            parts.append(F.col(c).cast("string"))
    return parts


def flag_top(scored: DataFrame, budget: float, *, score: str = "score", **kw) -> DataFrame:
    """Mark exactly the top ``max(1, round(budget·n))`` rows."""
    n = scored.where(F.col(score).isNotNull()).agg(F.count("*")).scalar()
    ranked = ranked_by_score(scored, score=score, **kw)
    return ranked.withColumn("flagged", F.col("rank") <= budget_size(n, F.lit(budget))).drop("hits")


def alert_budgets(
    scored: DataFrame,
    *,
    budgets: Sequence[float] = ALERT_BUDGETS,
    keys: Sequence[str] = (),
    score: str = "score",
    row_key: Sequence[str] = ROW_KEY,
    **kw,
) -> DataFrame:
    """Precision and recall when exactly the top share of rows is alerted, per budget (and key)."""
    keys = list(keys)
    narrow = scored.select(*dict.fromkeys([*keys, *row_key, "label", score]))
    ranked = ranked_by_score(narrow, keys=keys, score=score, row_key=row_key, **kw)
    totals = narrow.where(F.col(score).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(F.col("label").cast("bigint")).alias("pos")
    )
    wanted = totals.select(
        *keys, "n", "pos", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget")
    ).withColumn("k", budget_size(F.col("n"), F.col("budget")))
    # budgets × keys rows meet one ranked row each
    at_k = ranked.select(*keys, F.col("rank").alias("k"), "hits")
    joined = F.broadcast(wanted).join(at_k, [*keys, "k"])
    return joined.select(
        *keys,
        "budget",
        "k",
        F.col("hits").alias("flagged_positive"),
        (F.col("hits") / F.col("k")).alias("precision"),
        F.when(F.col("pos") > 0, F.col("hits") / F.col("pos")).alias("recall"),
    )


def best_budget(budget_rows: DataFrame) -> DataFrame:
    """The budget of highest precision, the smallest on a tie."""
    usable = budget_rows.where("precision IS NOT NULL AND NOT isnan(precision)")
    best = usable.agg(F.max_by(F.struct("budget", "precision", "recall"), F.struct("precision", -F.col("budget"))).alias("b"))
    return best.select(
        F.col("b.budget").alias("budget"), F.col("b.precision").alias("best_precision"), F.col("b.recall").alias("best_recall")
    )


def unpivot_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, value, label`` rows of the given feature columns."""
    wide = rows.select("label", *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(["label"], list(features), "feature", "value").withColumn(
        "value", F.when(~F.isnan("value"), F.col("value"))
    )


def single_feature_auc(test_rows: DataFrame, features: Sequence[str], **kw) -> DataFrame:
    """ROC-AUC of every raw feature on its own, missing values at the feature's median."""
    long = unpivot_features(test_rows, features)
    # everything below needs only rows and positives per distinct value
    counts = materialize(
        long.groupBy("feature", "value").agg(F.count("*").alias("_n"), F.sum(F.col("label").cast("bigint")).alias("_p")), "feature-values"
    )
    mids = exact_medians(counts, "value", keys=["feature"], weight="_n", **kw).select("feature", "median")
    filled = (
        counts.join(F.broadcast(mids), "feature")  # one row per feature
        .groupBy("feature", F.coalesce("value", "median").alias("_s"))
        .agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    )
    return _ranking_of_counts(filled, ["feature"], **kw).select("feature", F.col("roc_auc").alias("auc"))


def leakage_probe(feature_auc: DataFrame, shuffled_auc: float | None) -> DataFrame:
    """Strongest single feature (folded AUC) and whether either leak guard trips."""
    shuffled = F.lit(shuffled_auc).cast("double")
    worst = feature_auc.agg(F.coalesce(F.max(F.abs(F.col("auc") - 0.5) + 0.5), F.lit(0.5)).alias("max_single_feature_auc"))
    leaks = (F.coalesce(shuffled, F.lit(0.0)) > SHUFFLED_AUC_LIMIT) | (F.col("max_single_feature_auc") > FEATURE_AUC_LIMIT)
    return worst.select(shuffled.alias("shuffled_label_auc"), "max_single_feature_auc", leaks.alias("leaks"))


def feature_ranking(feature_auc: DataFrame) -> DataFrame:
    """Features by distance of their AUC from chance, names break ties."""
    return feature_auc.where("auc IS NOT NULL").orderBy(F.desc(F.abs(F.col("auc") - 0.5)), "feature")


def merge_rankings(rounds: DataFrame) -> DataFrame:
    """Best (most separating) AUC of each feature over all rounds."""
    best = rounds.groupBy("feature").agg(F.max_by("auc", F.abs(F.col("auc") - 0.5)).alias("auc"))
    return feature_ranking(best)


HOLDOUT_COLUMNS = ("gpu", "node", "gpu_idx", "t_ref", "horizon_s", "label")


def holdout_identity(test_rows: DataFrame, *, groups: int = 4096) -> DataFrame:
    """Order-free SHA-256 fingerprint of the held-out rows and labels.

    Row digests are grouped by their first hex digits and hashed in sorted order per
    group, then the group digests are hashed under a header naming the columns: a hash
    tree, so no task holds all row keys.
    """
    cols = [c for c in HOLDOUT_COLUMNS if c in test_rows.columns] or list(test_rows.columns)
    digits = max(1, (groups - 1).bit_length() // 4)
    digest = F.sha2(F.concat_ws("|", *row_key_columns(cols)), 256)
    rows = test_rows.select(digest.alias("d"))
    groups_ = rows.groupBy(F.substring("d", 1, digits).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("gd")
    )
    # at most 16^digits group digests meet here
    joined = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("g", "gd"))), lambda x: F.concat(x["g"], F.lit(":"), x["gd"])), "\n"
    )
    return groups_.agg(F.sha2(F.concat(F.lit(",".join(cols) + "\n"), joined), 256).alias("holdout_id"))


def no_skill_baseline(split_rows: DataFrame) -> DataFrame:
    """Constant score at the train base rate: AUC 0.5, AP equal to the test base rate.

    A test side without both classes, or an empty train side, is an error.
    """
    sides = split_rows.agg(
        F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_test"),
        F.avg(F.when(F.col("is_train"), F.col("label").cast("double"))).alias("train_base_rate"),
        F.avg(F.when(~F.col("is_train"), F.col("label").cast("double"))).alias("base_rate"),
    )
    scorable = (F.col("n_train") > 0) & (F.col("base_rate") > 0) & (F.col("base_rate") < 1)
    guarded = F.when(scorable, F.lit(0.5)).otherwise(
        F.raise_error(F.lit("baseline split not scorable")).cast("double")
    )
    return sides.select(
        guarded.alias("roc_auc"),
        F.col("base_rate").alias("avg_precision"),
        "base_rate",
        F.col("train_base_rate").alias("constant_score"),
        "n_train",
        "n_test",
    )


def class_balance(split_rows: DataFrame) -> DataFrame:
    """Rows and distinct labels per side, and whether both sides hold both classes."""
    sides = split_rows.agg(
        F.count_if("is_train").alias("n_train"),
        F.count_if(~F.col("is_train")).alias("n_val"),
        F.count_distinct(F.when(F.col("is_train"), F.col("label"))).alias("train_classes"),
        F.count_distinct(F.when(~F.col("is_train"), F.col("label"))).alias("val_classes"),
    )
    return sides.withColumn("balanced", (F.col("train_classes") >= 2) & (F.col("val_classes") >= 2))
