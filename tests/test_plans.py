"""What the plans must and must not hold."""

import contextlib
import io
import re

import pytest

from __spark_entry__ import queries


def plan(spark, folder, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        queries()[name](spark, folder).explain("formatted")
    return text.getvalue()


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(spark, folder, "review_project_dropna")
    assert "EqualTo(l_returnflag,R)" in text
    read = re.search(r"ReadSchema: struct<(.*)>", text).group(1)
    assert "l_extendedprice" not in read and "l_shipdate" not in read
    assert "Exchange" not in text


def test_groups_are_limited_before_the_shuffle(spark, folder):
    text = plan(spark, folder, "metacritic_records")
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_counts_combine_before_the_shuffle(spark, folder):
    text = plan(spark, folder, "rating_mean")
    assert "partial_avg" in text and text.count("Exchange (") == 1


NO_PAIRS = ["active_user_reviews", "accepted_hits", "anchor_catalogue_match", "catalogue_matches", "tiered_match", "mdp_transitions", "mdp_wide",
            "minmax_scaled", "ips_value", "top_recommendations", "unplayed_games", "game_scores"]


def test_transitions_join_their_vectors_once(spark, folder):
    # What the chunks are summed from is written, so the plan that is left reads it and the offsets only.
    assert plan(spark, folder, "mdp_wide").count("part.parquet") <= 2


@pytest.mark.parametrize("name", NO_PAIRS)
def test_no_join_without_a_key(spark, folder, name):
    text = plan(spark, folder, name)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_only_similarity_leaves_the_jvm(spark, folder):
    for name in ("review_union", "mdp_transitions", "genre_multihot", "rewards", "igdb_records"):
        assert "EvalPython" not in plan(spark, folder, name)
