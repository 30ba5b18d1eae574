"""Overlapping windows over rasters that are taller than those of the small tables."""

import pytest
from compare import check, connection

from canopyframe.plans.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.1"  # rasters of 157 rows


@pytest.mark.parametrize("name", ["a36_blend_windows", "a37_merge_last", "a37_merge_slots", "a37_merge_cropped", "a38_composite_patches"])
def test_windows_reach_every_row(spark, name):
    con = connection(FOLDER)
    assert con.execute("SELECT max(p_partkey // 4 // 32) FROM part").fetchone()[0] > 72
    got = QUERIES[name](spark, FOLDER)
    check(got, con, ORACLES[name])
    assert got.count() == con.execute("SELECT count(*) FROM part WHERE p_partkey % 37 <> 5").fetchone()[0]


@pytest.mark.parametrize("name", ["j22_fill_nearest_whole", "j22_fill_nearest_holes", "w05_terrain", "g12_upsample_bilinear"])
def test_whole_rasters_are_filled(spark, name):
    check(QUERIES[name](spark, FOLDER), connection(FOLDER), ORACLES[name])
