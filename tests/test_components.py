"""Components of masks by tiles against a flood fill."""

import random

import pytest

from tidemark.operators import raster


def flooded(pixels):
    """The first pixel of every pixel's component."""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start in left:
            todo = [start]
            left.discard(start)
            while todo:
                r, c = p = todo.pop()
                out[p] = start
                for q in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if q in left:
                        left.discard(q)
                        todo.append(q)
    return out


def snake(n):
    """A path that crosses every tile's border again and again."""
    out = set()
    for r in range(0, n, 2):
        out |= {(r, c) for c in range(n)}
        out.add((r + 1, n - 1 if r % 4 == 0 else 0))
    return out


@pytest.mark.parametrize("tile", [4, 7, 512])
def test_tiles_equal_flooding(spark, tile):
    r = random.Random(tile)
    scenes = {"noise": {(i, j) for i in range(40) for j in range(40) if r.random() < 0.6}, "snake": snake(30), "full": {(i, j) for i in range(20) for j in range(20)}, "far": {((1 << 22) + i, (1 << 21) + j) for i in range(9) for j in range(9) if (i + j) % 3}, "dots": {(i, j) for i in range(0, 30, 2) for j in range(0, 30, 2)}}
    rows = [(s, i, j, 5) for s, p in scenes.items() for i, j in p]
    df = spark.createDataFrame(rows + rows[:50], "scene string, row int, col int, y int").repartition(4)
    got = {}
    for x in raster.labelled(df, tile).collect():
        for c in range(x.c0, x.c1 + 1):
            assert (x.scene, x.row, c) not in got
            got[x.scene, x.row, c] = tuple(x.component)
    assert got == {(s, *p): first for s, pixels in scenes.items() for p, first in flooded(pixels).items()}
    assert raster.labelled(df.limit(0), tile).count() == 0
