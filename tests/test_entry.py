import sys

import pytest

from conftest import ROOT, SF_SMALL

sys.path.insert(0, ROOT)
import __spark_entry__ as E  # noqa: E402


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["split", "block_id", "x_md5", "y_md5"]
    assert df.count() > 0


def test_every_query_has_sql(spark):
    q, s = E.queries(), E.oracle_sql()
    own = {n for n in q if not (n == "pipeline" or n.startswith("op"))}
    assert own <= set(s) <= set(q)


@pytest.mark.parametrize("name", ["packed_blocks", "run_summary", "route_top1", "heldout_ppl",
                                  "early_stop", "live_early_stop"])
def test_queries_run_on_smallest_data(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    assert df.count() > 0
