"""What the plans must and must not contain."""

import pytest

import __spark_entry__ as entry
from halfstar.models import popularity
from halfstar.operators import recommend, sampling, split
from halfstar.sources import startables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# The last plan of these isn't looked at here: several seeds, or a whole experiment, are run to build it.
SLOW = {"multi_seed_fit", "multi_seed_biased_mf", "run_experiment", "pipeline"}


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_no_product_of_tables(spark, sf, name):
    text = plan(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_topk_drops_rows_before_the_shuffle(spark, sf, halves):
    for df in (recommend.topk_per_user(halves[0]), sampling.cap_candidates(halves[1])):
        text = plan(df)
        below = text[text.index("Exchange"):]
        assert "WindowGroupLimit" in below


def test_split_shuffles_once(spark, halves):
    text = plan(split.label_split(halves[0]))
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Sort [") == 1


def test_scan_reads_two_columns(spark, sf):
    text = plan(startables.movies(spark, sf).select("movieId"))
    assert "ReadSchema: struct<p_partkey:bigint>" in text


def test_filter_is_pushed(spark, sf):
    text = plan(startables.runs(spark, sf).where("model = 'SVD'"))
    assert "PushedFilters: [" in text and "event_type" in text.split("PushedFilters")[1]


def test_halves_are_partitions(halves):
    assert "PartitionFilters: [isnotnull(in_test" in plan(halves[1])


def test_counts_are_partially_aggregated(halves):
    text = plan(popularity.popularity_model(halves[0]))
    assert text.count("HashAggregate") == 2
