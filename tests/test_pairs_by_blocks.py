"""What is made of all pairs, over blocks cut small, against its SQL."""

import duckdb
import pytest
from test_queries import plain

from orrery.operators import blocks, precision, reid
from orrery.plans import catalog


@pytest.mark.parametrize("name", ["ag07_item_metrics", "ag08_average_precision", "ag09_eer_grid", "ag10_eer_exact", "jn16_identity_rank", "wn01_rank_of_first_hit"])
def test_small_blocks_give_the_same(spark, sf_dir, monkeypatch, name):
    monkeypatch.setattr(blocks, "LEFT", 60)
    monkeypatch.setattr(blocks, "RIGHT", 9)  # under an identity's rows, so that it is cut
    monkeypatch.setattr(reid, "FINE", 9)
    monkeypatch.setattr(reid, "SPELLED", 5)
    monkeypatch.setattr(precision, "CELLS", 100)
    df = catalog.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    r = con.execute(catalog.SQL[name])
    at = {c[0]: i for i, c in enumerate(r.description)}
    assert sorted(repr([plain(x[c]) for c in sorted(at)]) for x in df.collect()) == sorted(repr([plain(x[at[c]]) for c in sorted(at)]) for x in r.fetchall())


def test_no_pair_is_a_row_of_a_join(spark, sf_dir):
    plan = catalog.QUERIES["ag08_average_precision"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "aggregate(zip_with" not in plan and "MapInArrow" in plan
