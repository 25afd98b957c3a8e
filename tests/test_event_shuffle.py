"""What the event log shuffles."""

from runscope.sources import tables


def test_events_are_dealt_out_before_they_are_lines(spark, folder):
    plan = tables.event_contents(spark, folder)._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange ")
    assert len(below) == 2 and "INFO worker" not in below[1] and "collect_list" not in below[1]
