"""Physical plans: no nested loops, filters and columns reach the scan, pages are top-k."""

import pytest

from forgeframe.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.queries() if not n.startswith(("stream_", "history_", "merge_", "jsonl_"))))
def test_no_nested_loops(spark, name):
    text = plan(registry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_feed_page_prunes_and_takes_the_top(spark):
    text = plan(registry.queries()["feed_user_page"](spark, SF))
    assert "TakeOrderedAndProject" in text and "EqualTo(user_id,7)" in text and "LessThan(event_id,900)" in text
    assert "props" not in text.split("ReadSchema")[1]


def test_counts_and_dashboards_scan_once(spark):
    text = plan(registry.queries()["issue_dashboard"](spark, SF))
    assert text.count("FileScan") == 1


def test_existence_is_a_semi_join(spark):
    assert "LeftSemi" in plan(registry.queries()["feed_org_page"](spark, SF))
    assert "LeftAnti" in plan(registry.queries()["missing_rows"](spark, SF))
