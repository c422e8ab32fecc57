"""The experiment report, as one nested document and as text. All numbers come from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halfstar.functions.scalars import format_metric_line, fixed
from halfstar.operators.profile import matrix_density, rating_summary, table_counts
from halfstar.plans.compare import is_als, is_svd, performance_summary, scalability_verdict
from halfstar.sources.schemas import RUN_PARAMETERS


def _packed(one_row: DataFrame) -> Column:
    return one_row.select(F.struct(*one_row.columns).alias("packed")).scalar()


def report_document(
    results: DataFrame, ratings: DataFrame, movies: DataFrame, tags: DataFrame, links: DataFrame,
    description: str = "", test_size: float = 0.2, min_ratings: int = 5,
) -> DataFrame:
    """One row (document): the report as JSON, from results with speed-ups of one experiment."""
    counted = table_counts(ratings=ratings, movies=movies, tags=tags, links=links)
    tables = counted.agg(F.map_from_entries(F.collect_list(F.struct("table", "n"))).alias("rows"))
    statistics = F.struct(
        tables.scalar().alias("rows"),
        _packed(matrix_density(ratings)).alias("matrix"),
        _packed(rating_summary(ratings)).alias("ratings"),
    )
    # One entry per configuration, so the lists are as short as the results table.
    row = F.struct(*results.columns)
    details = results.agg(
        F.sort_array(F.collect_list(F.when(is_svd(), row))).alias("svd_baseline"),
        F.sort_array(F.collect_list(F.when(is_als(), row))).alias("spark_scalability"),
    )
    held = [c for c in [*RUN_PARAMETERS, "n_runs"] if c in results.columns]
    parameters = results.agg(F.sort_array(F.collect_list(F.struct("model", "num_cores", *held))).alias("parameters"))
    configuration = F.struct(
        parameters.scalar().alias("models"), F.lit(test_size).alias("test_size"), F.lit(min_ratings).alias("minimum_ratings_per_user"),
        F.lit("chronological per user").alias("split_method"), F.lit("median").alias("statistical_method"),
    )
    document = F.struct(
        F.struct(F.lit(description).alias("description")).alias("experiment_info"),
        statistics.alias("dataset_statistics"),
        configuration.alias("experiment_configuration"),
        _packed(performance_summary(results)).alias("performance_summary"),
        F.struct("svd_baseline", "spark_scalability").alias("detailed_results"),
        _packed(scalability_verdict(results)).alias("scalability_analysis"),
    )
    return details.select(F.to_json(document).alias("document"))


def report_sections(results: DataFrame) -> DataFrame:
    """One text section per configuration: (model, num_cores, section)."""
    has = set(results.columns)
    line = lambda label, c, unit="": format_metric_line(
        label, F.col(c), F.col(f"{c}_std") if f"{c}_std" in has else F.lit(0.0), unit
    )
    plain = lambda label, c, unit="": format_metric_line(label, F.col(c), unit=unit)
    lines = [
        F.concat(F.lit("### "), F.col("model"), F.lit(" (Cores: "), F.col("num_cores").cast("string"), F.lit(")")),
        line("Training Time", "train_time", " seconds"),
        line("Prediction Time", "prediction_time", " seconds"),
        line("RMSE", "rmse"),
        line("MAE", "mae"),
    ]
    if "precision_at_10" in has:
        lines += [
            plain("Precision@10", "precision_at_10"), plain("Recall@10", "recall_at_10"), plain("NDCG@10", "ndcg_at_10"),
        ]
    if "speedup_train" in has:
        lines += [plain("Speed-up", "speedup_train", "x"), plain("Efficiency", "efficiency_train")]
    return results.select("model", "num_cores", F.concat_ws("\n", *lines).alias("section"))


def report_text(results: DataFrame) -> DataFrame:
    """The text report, one row (value) per block, in reading order.

    A title that says how many runs stand behind a number, a section per
    configuration, and what came out best. Every figure is taken from ``results``.
    """
    counted = results if "n_runs" in results.columns else results.withColumn("n_runs", F.lit(None).cast("long"))
    low, high = F.min("n_runs").cast("string"), F.max("n_runs").cast("string")
    runs = F.when(low == high, low).otherwise(F.concat(low, F.lit(" to "), high))
    many = F.concat(F.lit("# "), F.count(F.lit(1)).cast("string"), F.lit(" configurations"))
    behind = F.coalesce(F.concat(F.lit(", "), runs, F.lit(" runs each: medians, with the spread of the runs")), F.lit(""))
    title = counted.agg(F.concat(many, behind).alias("value"))
    named = F.concat(F.col("model"), F.lit(" on "), F.col("num_cores").cast("string"), F.lit(" cores"))
    rows = results.withColumn("named", named)
    least = F.struct(F.min("rmse").alias("value"), F.min_by("named", F.struct("rmse", "named")).alias("named"))
    most = F.struct(F.max("speedup_train").alias("value"), F.max_by("named", F.struct("speedup_train", "named")).alias("named"))
    has_speedup = "speedup_train" in results.columns
    best = rows.agg(least.alias("error"), (most if has_speedup else F.lit(None)).alias("fastest"))
    lines = [F.concat(F.lit("Least RMSE: "), fixed(F.col("error.value")), F.lit(", "), F.col("error.named"))]
    if has_speedup:
        lines.append(F.concat(F.lit("Greatest training speed-up: "), fixed(F.col("fastest.value")), F.lit("x, "), F.col("fastest.named")))
    findings = best.select(F.concat_ws("\n", F.lit("## Best of all"), *lines).alias("value"))
    sections = report_sections(results)
    of = lambda place, df, text: df.select(F.lit(place).alias("place"), *text)
    none = [F.lit("").alias("model"), F.lit(0).alias("num_cores")]
    blocks = (
        of(0, title, [*none, "value"])
        .unionAll(of(1, sections, ["model", "num_cores", F.concat("section", F.lit("\n"))]))
        .unionAll(of(2, findings, [*none, "value"]))
    )
    return blocks.coalesce(1).sortWithinPartitions("place", F.desc("model"), "num_cores").select("value")
