"""Whole-column measures against the row-by-row functions, and cells that follow the crowd."""

import random

import numpy as np
import pyarrow as pa
import pytest

from terrafold.functions import arrow, vector
from terrafold.functions import scalar as S
from terrafold.geom import model
from terrafold.operators.join import cell_size


def shapes(kind, rng, n):
    out = []
    for _ in range(n):
        x, y, w = rng.uniform(-50, 50), rng.randint(-50, 50), rng.randint(1, 9)
        if kind == "point":
            out.append(f"POINT({x} {y})")
        elif kind == "line":
            out.append("LINESTRING(" + ",".join(f"{x + k * w} {y + k % 3}" for k in range(rng.randint(2, 6))) + ")")
        else:
            ring = f"({x} {y},{x + 4 * w} {y},{x + 4 * w} {y + 4 * w},{x} {y + 4 * w},{x} {y})"
            hole = f",({x + w} {y + w},{x + w} {y + 2 * w},{x + 2 * w} {y + 2 * w},{x + w} {y + w})" if kind == "holed" and rng.random() < 0.5 else ""
            out.append(f"POLYGON({ring}{hole})")
    return out


def columns(kind, rng):
    text = shapes(kind, rng, 40)
    text[3] = text[17] = None
    made = [None if t is None else model.read_wkt(t) for t in text]
    plain, stamped = ([None if g is None else model.write_wkb(model.with_srid(g, s)) for g in made] for s in (0, 4326))
    yield pa.array(text, pa.string())
    yield pa.array(text, pa.string()).slice(2, 30)
    for raw in (plain, stamped):
        yield pa.array(raw, pa.binary())
        yield pa.array(raw, pa.binary()).slice(5, 21)


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, rel=1e-12, abs=1e-9))


@pytest.mark.parametrize("kind", ["point", "line", "polygon", "holed"])
def test_columns_equal_rows(kind):
    rng, taken = random.Random(6), 0
    for column in columns(kind, rng):
        for name in vector.MEASURES:
            f = S.SCALARS[name]
            rows = [None if g is None else f.call(g) for g in arrow.geometries(column, name)]
            found = vector.measure(name, column)
            if found is not None:
                taken += 1
                assert found.type == arrow.ARROW[f.result]
                assert all(same(a, b) for a, b in zip(found.to_pylist(), rows, strict=True)), (name, column.type)
            assert all(same(a, b) for a, b in zip(arrow.run(f, (column,)).to_pylist(), rows, strict=True))
    assert taken >= len(vector.MEASURES) * (4 if kind == "holed" else 6) / 2


@pytest.mark.parametrize("rows", [["POINT(1 2)", "LINESTRING(0 0,1 1)"], ["POINT EMPTY", "POINT(1 2)"], ["POINT Z(1 2 3)", "POINT(1 2)"], [" POINT(1 2)", "POINT(1 2)"], ["POLYGON((0 0,1 0,1 1,0 0))", "POLYGON((0 0, 1 0,1 1,0 0))"], ["POINT(1 2 3)", "POINT(1 2 3)"], [None, None], ["POINT(1e1 2)", "POINT(- 2)"]])
def test_others_go_row_by_row(rows):
    column = pa.array(rows, pa.string())
    assert vector.measure("ST_Area", column) is None
    if "- 2" not in str(rows):
        assert len(arrow.run(S.SCALARS["ST_XMin"], (column,))) == 2


def test_mixed_binary_goes_row_by_row():
    rows = [model.write_wkb(model.point(1, 2)), model.write_wkb(model.line([[0, 0], [3, 4]])), model.write_wkb(model.read_wkt("POLYGON EMPTY"))]
    assert vector.measure("ST_Length", pa.array(rows, pa.binary())) is None
    assert arrow.run(S.SCALARS["ST_Length"], (pa.array(rows, pa.binary()),)).to_pylist() == [0, 5, 0]


def test_cells_shrink_where_rows_crowd():
    rng = np.random.default_rng(1)
    even, n = rng.random((4000, 2)) * 1000, 1_000_000
    assert cell_size(1.0, even, n, 1e-6) > 0.4
    crowded = np.concatenate([even[:100] * 100, rng.random((3900, 2))])
    small = cell_size(100.0, crowded, n, 1e-6)
    own = np.unique(np.floor(crowded / small), axis=0, return_counts=True)[1]
    assert small < 1 and (own * (own - 1)).sum() / 4000 / 3999 * n < 1000
    assert cell_size(100.0, np.zeros((50, 2)), n, 1e-3) < 0.01 and cell_size(5.0, np.empty((0, 2)), 0, 1.0) == 5.0
