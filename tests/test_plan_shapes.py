"""Physical-plan properties the design relies on (see PLANS.md)."""

import re

import pytest

import __spark_entry__ as E

from conftest import SF_SMALL

ROWS_ONLY = {"score_stream", "select_model", "train_classifier", "validate_classifier", "model_scores"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["score_v2", "score_v1", "analyze", "lexicon_matches", "term_count"])
def test_scoring_is_one_scan_and_one_matcher(spark, name):
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert len(re.findall(r"ArrowEvalPython", plan)) == 1
    assert not re.search(r"CartesianProduct|NestedLoop|SortMergeJoin|Window|Sort \[|hashpartitioning", plan)
    assert len(re.findall(r"Join", plan)) == (name == "lexicon_matches")  # with the lexicon, broadcast by its size
    assert len(re.findall(r"FileScan parquet", plan)) == 1


@pytest.mark.parametrize("name", ["score_v2", "score_v1", "analyze", "term_count"])
def test_features_read_bitmaps(spark, name):
    """The matcher returns one or two arrays, not a column per term."""
    plan = plan_of(E.queries()[name](spark, SF_SMALL))
    assert "bits" in plan and not re.search(r"__t\d", plan)


def test_dedup_and_means_aggregate_before_the_shuffle(spark):
    for name in ("dedup_keep_first", "annotator_means", "domain_report"):
        plan = plan_of(E.queries()[name](spark, SF_SMALL))
        assert re.search(r"partial_", plan), name


def test_samples_filter_without_sorting_or_gathering(spark):
    for name in ("balanced_sample", "class_examples", "debug_sample", "stratified_split", "stratified_split_all"):
        plan = plan_of(E.queries()[name](spark, SF_SMALL))
        assert not re.search(r"TakeOrdered|Sort \[|Window|Exchange", plan), name
    for name in ("shuffle_rank", "shuffle_rank_all"):
        plan = plan_of(E.queries()[name](spark, SF_SMALL))
        assert "SinglePartition" not in plan, name


def test_dedup_finds_the_first_without_texts(spark):
    """Texts appear in no aggregate but the one that drops ties, which only the
    first rows of repeated keys reach."""
    plan = plan_of(E.queries()["dedup_keep_first"](spark, SF_SMALL))
    assert "min_by" not in plan
    carrying = [x for x in plan.split("\n") if "Aggregate" in x and "comment_text" in x]
    assert all("first(comment_text" in x for x in carrying)


def test_no_query_uses_a_cross_product(spark):
    from slantscan.plans import registry
    for name, fn in registry.Q.items():
        if name in ROWS_ONLY:
            continue
        plan = plan_of(fn(spark, SF_SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
