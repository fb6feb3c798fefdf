"""Results do not depend on the number of shuffle partitions (what a
recomputation after an executor loss or a different cluster size sees)."""

import pytest

import __spark_entry__ as E

from conftest import SF001

NAMES = ["qa_report", "l1_resolve_verdicts", "i1_running_accuracy", "j2_seeded_sample",
         "j3_train_eval_split", "h5_identical_pct", "k7_ngram_preference", "d4_render_chatml",
         "h7_win_rates", "c6_funnel"]


def _rows(spark, name, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        return sorted(map(tuple, E.queries()[name](spark, SF001).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", NAMES)
def test_partition_count_does_not_change_results(spark, name):
    assert _rows(spark, name, 3) == _rows(spark, name, 17)
