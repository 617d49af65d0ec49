"""What the questions of two runs leave on disk."""

from rentlake import catalog
from tests.test_merge_room import written

SF = "/root/testdata/sf0.001"


def test_questions_of_a_run_go_when_they_are_entered(spark):
    before = written(spark)
    table = catalog.QUERIES["t35_request_table"](spark, SF)
    left = written(spark) - before
    assert len(left) == 1 and next(iter(left)).startswith("t35-")
    assert table.count() > 0 and table.where("listings is null").isEmpty()
