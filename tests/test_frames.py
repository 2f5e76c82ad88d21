"""Pictures against plain loops over their pixels."""

import math
import random

import numpy as np
import pytest

from sightline.operators import frames


def plain(p, width, height):
    """Cover, cut and pad of a list of rows of (r, g, b)."""
    h, w = len(p), len(p[0])
    scale = max(width / w, height / h)
    nw, nh = max(1, int(w * scale)), max(1, int(h * scale))

    def at(x, y, c):
        sx, sy = (min(max((v + 0.5) * old / new - 0.5, 0), old - 1) for v, old, new in ((x, w, nw), (y, h, nh)))
        x0, y0 = math.floor(sx), math.floor(sy)
        x1, y1, fx, fy = min(x0 + 1, w - 1), min(y0 + 1, h - 1), sx - x0, sy - y0
        return math.floor((p[y0][x0][c] * (1 - fx) + p[y0][x1][c] * fx) * (1 - fy) + (p[y1][x0][c] * (1 - fx) + p[y1][x1][c] * fx) * fy + 0.5)

    ox, oy = max(0, (nw - width) // 2), max(0, (nh - height) // 2)
    px, py = max(0, (width - nw) // 2), max(0, (height - nh) // 2)
    inside = lambda x, y: px <= x < px + min(nw, width) and py <= y < py + min(nh, height)
    return [[[at(x - px + ox, y - py + oy, c) for c in range(3)] if inside(x, y) else [0, 0, 0] for x in range(width)] for y in range(height)]


@pytest.mark.parametrize(("width", "height"), [(5, 3), (8, 8), (3, 7), (20, 11), (1, 1)])
def test_against_loops(spark, width, height):
    rng = random.Random(width)
    data, want = [], {}
    for i in range(12):
        w, h = rng.choice([(8, 8), (3, 5), (7, 2), (1, 1)])
        p = [[[rng.randint(0, 255) for _ in range(3)] for _ in range(w)] for _ in range(h)]
        data.append((i, w, h, bytearray(v for row in p for c in row for v in c)))
        want[i] = plain(p, width, height)
    data += [(90, 2, 2, None), (91, 2, 2, bytearray(b"abc")), (92, 0, 0, bytearray()), (93, None, 1, bytearray(b"abc"))]
    want |= dict.fromkeys((90, 91, 92, 93), [[[0] * 3] * width] * height)
    out = frames.resample(spark.createDataFrame(data, "picture_id long, width int, height int, pixels binary").repartition(3), width, height)
    got = {r.picture_id: np.frombuffer(bytes(r.pixels), np.uint8).reshape(height, width, 3).tolist() for r in out.collect()}
    assert got == want


def test_values_for_a_model(spark):
    one = spark.createDataFrame([(1, 1, 1, bytearray((255, 51, 0)))], "picture_id long, width int, height int, pixels binary")
    mean, std = (0.5, 0.4, 0.3), (0.25, 0.5, 0.1)
    assert frames.resample(one, 1, 1, mean, std).first()["values"] == pytest.approx([1 - 2, 0.2 - 0.8, 0 - 3], abs=1e-6)
    assert frames.resample(one, 1, 1, mean, std, divide_all=True).first()["values"] == pytest.approx([2, -0.4, -3], abs=1e-6)


def test_pictures_of_pixel_rows(spark):
    rows = [(1, 0, 0, 1, 2, 3), (1, 1, 0, 255, 16, 0), (1, 1, 0, 254, 99, 99), (1, 9, 0, 7, 7, 7), (2, 1, 1, 10, 11, 12)]
    px = spark.createDataFrame(rows, "id long, px_x int, px_y int, r int, g int, b int")
    got = {r.picture_id: bytes(r.pixels) for r in frames.assemble(px, "id", 2, 2).collect()}
    assert got == {1: bytes([1, 2, 3, 255, 16, 0, *[0] * 6]), 2: bytes([*[0] * 9, 10, 11, 12])}
