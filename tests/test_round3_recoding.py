"""Re-coding joins and groups the order lines once."""

import os

import pytest

from lorekeep.plans import registry, revisions
from tests.oracle import TESTDATA

FOLDER = f"{TESTDATA}/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="shared tables are not there")
@pytest.mark.parametrize("name", ["_recode_degrees", "_recode_closure"])
def test_order_lines_are_read_once(spark, name):
    tables, read = registry.Tables(spark, FOLDER), spark.sparkContext.accumulator(0)
    lines = tables.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")

    def counted(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    tables.lineitem = lines.mapInPandas(counted, lines.schema)
    assert getattr(revisions, name)(tables).count() > 0
    assert read.value == lines.count()
