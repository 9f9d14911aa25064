"""Tables of cells stay in many partitions, however few bytes they have."""

from catalog.tables import Tables
from tallyscope.functions.session import SPREAD
from tallyscope.operators.correlation import paired_cells


def test_cells_are_not_merged_into_few_tasks(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    cells = paired_cells(t.ref(), t.cand())
    assert t.counts().rdd.getNumPartitions() >= SPREAD and cells.rdd.getNumPartitions() >= SPREAD
    assert cells.count() == t.counts().count()
