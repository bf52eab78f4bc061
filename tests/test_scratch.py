from pathlib import Path

from lexiquarry.scratch import materialize


def test_tables_hold_their_rows_and_no_marker(spark):
    out = materialize(spark.range(100).repartition(3), "marker")
    names = [p.name for p in Path(out.scratch_path.removeprefix("file:")).iterdir()]
    assert not [n for n in names if "_SUCCESS" in n] and len([n for n in names if n.startswith("part-")]) == 3
    assert sorted(r.id for r in out.collect()) == list(range(100))
