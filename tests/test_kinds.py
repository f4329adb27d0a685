"""Reading only some kinds of coordinates gives the same variants, and errors for the others."""

import pytest

from allelic.functions.parse import with_variant

TEXTS = ["NC_1.1:g.5del", "NC_1.1:m.5A>T", "NM_1.1:c.5_6insA", "NR_1.1:n.5+1G>A", "NM_1.1:r.5a>g", "NP_1.1:p.(Lys5Ter)", "NC_1.1:g.(?_5)_(7_?)del", "nonsense", "", None]


@pytest.mark.parametrize("kinds", ["g", "c", "p", "gm", "cnr"])
def test_kinds(spark, kinds):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    whole = {r["t"]: r["variant"] for r in with_variant(rows, "t").collect()}
    for r in with_variant(rows, "t", kinds=kinds).collect():
        own = whole[r["t"]] is not None and whole[r["t"]]["coord"] in kinds
        assert r["variant"] == (whole[r["t"]] if own else None)
        assert (r["variant_error"] is not None) == (not own and r["t"] is not None)
