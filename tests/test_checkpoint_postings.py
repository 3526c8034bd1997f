"""Postings behind checkpoints are joined once, however often they are folded."""

from tallyframe.plans import catalog

SF = "/root/testdata/sf0.001"


def text_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_postings_of_checkpoints_are_joined_once(spark):
    assert "p_type" not in text_of(catalog.QUERIES["aregister_checkpoint"](spark, SF))
