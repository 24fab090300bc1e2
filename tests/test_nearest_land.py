"""Banks of wide water against brute force."""

import random

import pytest

from tessera.operators import flood


def expected(cells, water):
    land = {at: v for at, v in cells.items() if at not in water}
    return {(r, c): min(((r - a) ** 2 + (c - b) ** 2, v) for (a, b), v in land.items())[1] for r, c in water}


@pytest.mark.parametrize("rings", [2, 12])
def test_lake_wider_than_the_squares(spark, rings):
    rnd = random.Random(5)
    cells = {(r, c): float(rnd.randrange(9)) for r in range(-3, 44) for c in range(48) if rnd.random() < 0.97 or r < 0}
    water = {at for at in cells if 1 < at[0] < 40 and 2 < at[1] < 46 and at not in ((9, 30), (22, 23), (23, 22))}
    grid = spark.createDataFrame([(*at, v) for at, v in cells.items()], "row int, col int, elev double")
    lake = spark.createDataFrame(list(water), "row int, col int")
    got = {(r["row"], r["col"]): r["bank"] for r in flood.nearest_land(grid, lake, rings).collect()}
    assert got == expected(cells, water)


def test_land_beside_the_square_is_nearer_than_in_its_corner(spark):
    cells = {(0, 0): 0.0, (12, 10): 1.0, (13, 0): 2.0, (0, 40): 0.0}
    grid = spark.createDataFrame([(*at, v) for at, v in cells.items()], "row int, col int, elev double")
    lake = spark.createDataFrame([(0, 0), (0, 40)], "row int, col int")
    got = {(r["row"], r["col"]): r["bank"] for r in flood.nearest_land(grid, lake, 12).collect()}
    assert got == {(0, 0): 2.0, (0, 40): 1.0}
    assert flood.nearest_land(lake.selectExpr("row", "col", "0D AS elev"), lake, 12).count() == 0
