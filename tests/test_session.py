import os

from gridweave.session import cut_lineage, intermediates


def test_intermediates_go_when_their_scope_ends(spark):
    with intermediates(spark):
        kept = cut_lineage(spark.range(3))
        with intermediates(spark):
            inner = cut_lineage(spark.range(5)).inputFiles()[0]
        assert kept.count() == 3
        outer = kept.inputFiles()[0]
    for f in (inner, outer):
        assert not os.path.exists(os.path.dirname(f.removeprefix("file:").replace("///", "/")))
