"""Drawings are made up from absolute points, written in several ways, and held against those points."""

import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.functions import paths as P

PLACES = {"M": 1, "L": 1, "H": 1, "V": 1, "Q": 2, "T": 1, "Z": 0}


@st.composite
def drawings(draw, low=-1100, high=1100, digits=1):
    """[(command, points)], with the points of H and V on the pen's line."""
    number = lambda: round(draw(st.integers(low * 10**digits, high * 10**digits)) / 10**digits, digits)
    pen = start = (number(), number())
    out = [("M", [pen])]
    for _ in range(draw(st.integers(0, 12))):
        kind = draw(st.sampled_from("MLHVQTZ"))
        points = [(number(), number()) for _ in range(PLACES[kind])]
        if kind == "H":
            points = [(points[0][0], pen[1])]
        if kind == "V":
            points = [(pen[0], points[0][1])]
        out.append((kind, points))
        pen = points[-1] if points else start
        start = pen if kind == "M" else start
    return out


def spell(drawing, relative, separator=" "):
    """The drawing as text, each command absolute or relative by its place in `relative`."""
    out, pen, start = [], (0.0, 0.0), (0.0, 0.0)
    for k, (kind, points) in enumerate(drawing):
        small = relative[k % len(relative)]
        base = pen if small else (0.0, 0.0)
        numbers = [[x - base[0], y - base[1]] for x, y in points]
        numbers = [numbers[0][0]] if kind == "H" else [numbers[0][1]] if kind == "V" else sum(numbers, [])
        out.append((kind.lower() if small else kind) + separator.join(f"{round(v, 4):g}" if abs(v) < 1e5 else f"{v:f}" for v in numbers))
        pen = points[-1] if points else start
        start = pen if kind == "M" else start
    return "".join(out)


def flat(pairs):
    return [v for xy in pairs for v in xy]


WAYS = st.lists(st.booleans(), min_size=1, max_size=5)


@settings(max_examples=150, deadline=None)
@given(drawings(), WAYS, st.sampled_from([" ", ",", "\n"]))
def test_all_spellings_have_the_same_points(drawing, ways, separator):
    got = list(P.absolute(spell(drawing, ways, separator)))
    assert [k for k, _ in got] == [k for k, _ in drawing]
    assert flat(sum((p for _, p in got), [])) == pytest.approx(flat(sum((p for _, p in drawing), [])), abs=1e-2)


@settings(max_examples=100, deadline=None)
@given(drawings())
def test_smooth_curves_mirror_their_control_points(drawing):
    want, pen, start, control = [], None, None, None
    for kind, points in drawing:
        if kind == "T":
            control = pen if control is None else tuple(2 * a - b for a, b in zip(pen, control))
            want.append(control)
        else:
            control = points[0] if kind == "Q" else None
        want += points
        pen = points[-1] if points else start
        start = pen if kind == "M" else start
    assert flat(P.points(spell(drawing, [False]))) == pytest.approx(flat(want), abs=1e-2)


@settings(max_examples=150, deadline=None)
@given(drawings(0, 48), WAYS, st.sampled_from([(0, 0, 48), (12, -7, 48), (0, 96, 240)]))
def test_normalized_points_are_moved_and_scaled(drawing, ways, box):
    vx, vy, side = box
    scale = 960 / side
    text = P.normalized(spell(drawing, ways), [vx, vy, side, side])
    want = [((x - vx) * scale, (y - vy) * scale - 960) for _, p in drawing for x, y in p]
    got = [xy for _, p in P.absolute(text) for xy in p]
    assert flat(got) == pytest.approx(flat(want), abs=0.01 * len(drawing) + scale * 1e-3)
    assert all(len(n.partition(".")[2]) <= 2 for n in re.findall(r"-?[0-9.]+", text))


@given(drawings(-960, 960), WAYS)
@settings(max_examples=30, deadline=None)
def test_what_is_on_the_canvas_already_stays_as_it_is_written(drawing, ways):
    text = spell(drawing, ways)
    assert P.normalized(text, [0, -960, 960, 960]) == text


@settings(max_examples=150, deadline=None)
@given(drawings(-960, 960), WAYS, st.sampled_from([960.0, 480.0]))
def test_quantized_points_are_the_nearest_of_the_grid(drawing, ways, grid):
    text = spell(drawing, ways)
    small = P.quantized(text, grid)
    exact = [(k, [(math.floor(x * grid / 960 + 0.5), math.floor(y * grid / 960 + 0.5)) for x, y in p]) for k, p in P.absolute(text)]
    got = list(P.absolute(small))
    assert [k for k, _ in got] == [k for k, _ in exact]
    assert flat(sum((p for _, p in got), [])) == flat(sum((p for _, p in exact), []))
    assert "." not in small and "," not in small and P.quantized(small) == small


@settings(max_examples=100, deadline=None)
@given(drawings())
def test_off_the_canvas(drawing):
    points = sum((p for _, p in drawing), [])
    inside = all(-48 <= x <= 1008 and -1008 <= y <= 48 for x, y in points)
    said = P.outside(spell(drawing, [False]))
    assert (said is None) == inside and (inside or said.startswith("off the canvas at"))


@pytest.mark.parametrize(
    ("call", "said"),
    [
        (lambda: list(P.absolute("M3 4A1 1 0 0 0 9 9")), "no command is called A"),
        (lambda: list(P.absolute("M3 4L7")), "too few numbers after L"),
        (lambda: list(P.absolute("M3 4Q7 7z")), "too few numbers after Q"),
        (lambda: list(P.absolute("3 4")), "before any command"),
        (lambda: list(P.absolute("M1 1z2")), "before any command"),
        (lambda: P.normalized("M3 4", [0, 0, 7, 9]), "no square: 7 by 9"),
        (lambda: P.svg('<svg viewBox="0 0 9 9"></svg>'), "0 paths"),
        (lambda: P.svg('<svg viewBox="0 0 9 9"><path d="M1 1"/><path d="M2 2"/><path d="M3 3"/></svg>'), "3 paths"),
        (lambda: P.svg('<svg viewBox="0 0 9 9"><circle r="2"/><path d="M1 1"/></svg>'), "more than a path: circle"),
        (lambda: P.svg('<svg viewBox="0 0 9 9"><path d="M1 1" stroke="red"/></svg>'), "more than d: stroke"),
        (lambda: P.svg('<svg viewBox="0 0 9"><path d="M1 1"/></svg>'), "four numbers"),
        (lambda: P.svg('<svg width="wide" height="9"><path d="M1 1"/></svg>'), "four numbers"),
        (lambda: P.svg('<svg viewBox="0 0 9 9"><path/></svg>'), "not drawn"),
    ],
)
def test_refused(call, said):
    with pytest.raises(P.PathError, match=said):
        call()


def test_files():
    assert P.svg('<svg xmlns="x" viewBox="3 5 40 40"><path d="M1 2h3"/></svg>') == ("M1 2h3", [3, 5, 40, 40])
    assert P.svg('<svg width="18" height="18"><path d="M0 0z"/></svg>') == ("M0 0z", [0, 0, 18, 18])


def test_rasters_by_area():
    side = lambda x, y, w, h: f"M{x} {y}h{w}v{h}h{-w}z"
    assert P.raster(side(0, -960, 960, 960)).all() and P.raster(side(0, -960, 960, 960)).shape == (96, 96)
    assert P.raster(side(200, -500, 300, 100)).sum() == 30 * 10
    assert P.raster(side(100, -900, 500, 500) + "M200-800v300h300v-300z").sum() == 50 * 50 - 30 * 30  # the inner one runs the other way
    assert P.raster(side(100, -900, 500, 500) + side(200, -800, 300, 300)).sum() == 50 * 50
    triangle = P.raster("M0 0L960 0L0-960z").sum() / 96**2
    assert triangle == pytest.approx(0.5, abs=0.01)
    bump = P.raster("M0 0Q480-960 960 0z").sum() / 96**2  # two thirds of the control triangle
    assert bump == pytest.approx(1 / 3, abs=0.02)
    assert not P.raster("M5-5L9-9").any() and P.raster("M0 0T900-900L900 0z").any()


def test_columns(spark):
    texts = ["M12.4-7.6H30.2V-40.5z", None, "M0 0l2.5 2.5"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    assert [r[0] for r in df.select(P.quantize(df.d)).collect()] == [None if t is None else P.quantized(t) for t in texts]
    assert [r[0] for r in df.select(P.all_points(df.d)).collect()] == [None if t is None else flat(P.points(t)) for t in texts]
    assert [r[0] for r in df.select(P.canvas_error(df.d)).collect()] == [None, None, None]
    files = spark.createDataFrame([('<svg viewBox="0 0 96 96"><path d="M9 9h9"/></svg>',), ("no file",), (None,)], "t string")
    got = [r[0] for r in files.select(P.from_svg(files.t)).collect()]
    assert got[0]["d"] == P.normalized("M9 9h9", [0, 0, 96, 96]) and got[0]["error"] is None
    assert all(g["d"] is None and g["error"] for g in got[1:])
    assert np.array_equal(P.winding(np.array([(0, 0), (960, 0), (960, -960), (0, -960)])) != 0, np.ones((96, 96), dtype=bool))
