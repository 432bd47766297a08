"""Drawing paths: commands M L H V Q T Z, absolute (upper case) or relative. Columns of texts in, columns of texts or points out."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBERS = {"M": 2, "L": 2, "H": 1, "V": 1, "Q": 4, "T": 2, "Z": 0}
SIDE = 960.0
LEFT, RIGHT, TOP, BOTTOM = -48.0, 1008.0, -1008.0, 48.0  # the canvas with a margin of a twentieth
_PART = re.compile(r"([A-Za-z])|(-?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


class PathError(ValueError):
    pass


def half_up(v: float) -> int:
    return math.floor(v + 0.5)


def written(d: str) -> Iterator[tuple[str, bool, list[float]]]:
    """Each command as it is written: letter, whether the letter itself is written (it may be implied by further numbers), and numbers."""
    letter, waiting = "", []
    for m in _PART.finditer(d):
        if m[1]:
            if waiting:
                raise PathError(f"too few numbers after {letter}")
            letter, shown = m[1], True
            if letter.upper() not in NUMBERS:
                raise PathError(f"no command is called {letter}")
            if letter in "Zz":
                yield letter, True, []
            continue
        if letter in ("", "Z", "z"):
            raise PathError("a number stands before any command")
        waiting.append(float(m[2]))
        if len(waiting) == NUMBERS[letter.upper()]:
            yield letter, shown, waiting
            waiting, shown = [], False
            letter = {"M": "L", "m": "l"}.get(letter, letter)
    if waiting:
        raise PathError(f"too few numbers after {letter}")


def absolute(d: str) -> Iterator[tuple[str, list[tuple[float, float]]]]:
    """Upper-case letters with absolute points: control point and end for Q, the end for the others, none for Z."""
    pen = start = (0.0, 0.0)
    for letter, _, n in written(d):
        kind = letter.upper()
        base = pen if letter != kind else (0.0, 0.0)
        if kind == "Z":
            pen = start
            yield kind, []
            continue
        if kind == "H":
            points = [(n[0] + base[0], pen[1])]
        elif kind == "V":
            points = [(pen[0], n[0] + base[1])]
        else:
            points = [(x + base[0], y + base[1]) for x, y in zip(n[::2], n[1::2])]
        pen = points[-1]
        if kind == "M":
            start = pen
        yield kind, points


def points(d: str) -> list[tuple[float, float]]:
    """All end and control points. The control point of T is the last one, mirrored at the pen."""
    out, pen, start, control = [], (0.0, 0.0), (0.0, 0.0), None
    for kind, p in absolute(d):
        if kind == "Z":
            pen, control = start, None
            continue
        if kind == "T":
            control = (2 * pen[0] - control[0], 2 * pen[1] - control[1]) if control else pen
            out.append(control)
        else:
            control = p[0] if kind == "Q" else None
        out += p
        pen = p[-1]
        if kind == "M":
            start = pen
    return out


def normalized(d: str, box: list[float]) -> str:
    """The path on a canvas of SIDE units whose y runs from -SIDE to 0; unchanged where it already is. A leading m is absolute for its first pair."""
    vx, vy, wide, high = box
    if wide != high:
        raise PathError(f"the canvas is no square: {wide:g} by {high:g}")
    if (vx, vy, wide) == (0, -SIDE, SIDE):
        return d
    scale, out = SIDE / wide, []
    for i, (letter, shown, n) in enumerate(written(d)):
        first = i == 0 and letter == "m"
        relative = letter.islower() and not first
        axes = {"H": "x", "V": "y"}.get(letter.upper(), "xy" * (len(n) // 2))
        moved = [v * scale if relative else (v - vx) * scale if a == "x" else (v - vy) * scale - SIDE for v, a in zip(n, axes)]
        after_m = i == 1 and not shown and letter == "l" and out[0][0] == "M" and d.lstrip()[0] == "m"
        out.append(("M" if first else letter if shown or after_m else " ") + " ".join(map(_two_places, moved)))
    return "".join(out)


def _two_places(v: float) -> str:
    r = half_up(v * 100) / 100
    return f"{r:.2f}".rstrip("0").rstrip(".") if r else "0"


def quantized(d: str, grid: float = SIDE) -> str:
    """Points snapped to whole units, commands relative, letters and spaces only where they are needed. Rounding is of absolute points, so it never adds up."""
    out, last, pen, start = "", "", (0, 0), (0, 0)
    for i, (kind, p) in enumerate(absolute(d)):
        if kind == "Z":
            out, last, pen = out + "z", "z", start
            continue
        snapped = [(half_up(x * grid / SIDE), half_up(y * grid / SIDE)) for x, y in p]
        letter = "M" if i == 0 and kind == "M" else kind.lower()
        base = (0, 0) if letter == "M" else pen
        moves = [(x - base[0], y - base[1]) for x, y in snapped]
        numbers = [moves[0][0]] if kind == "H" else [moves[0][1]] if kind == "V" else [v for xy in moves for v in xy]
        out += "" if letter == last and kind != "M" else letter
        for v in numbers:
            out += f" {v}" if v >= 0 and out[-1].isdigit() else str(v)
        pen, last = snapped[-1], letter
        if kind == "M":
            start = pen
    return out


def outside(d: str) -> str | None:
    """The first written point that leaves the canvas, as text."""
    for _, ps in absolute(d):
        for x, y in ps:
            if not (LEFT <= x <= RIGHT and TOP <= y <= BOTTOM):
                return f"off the canvas at ({x:g}, {y:g})"
    return None


def svg(text: str) -> tuple[str, list[float]]:
    """Path and view box of a file with one path, and nothing but it."""
    tags = re.findall(r"<([a-zA-Z][\w-]*)([^>]*)>", text)
    other = sorted({t for t, _ in tags} - {"svg", "path"})
    if other:
        raise PathError(f"there is more than a path: {', '.join(other)}")
    paths = [a for t, a in tags if t == "path"]
    if len(paths) != 1:
        raise PathError(f"{len(paths)} paths instead of one")
    given = dict(re.findall(r"([\w:-]+)\s*=\s*\"([^\"]*)\"", paths[0]))
    if extra := sorted(set(given) - {"d"}):
        raise PathError(f"the path has more than d: {', '.join(extra)}")
    root = dict(re.findall(r"([\w:-]+)\s*=\s*\"([^\"]*)\"", next(a for t, a in tags if t == "svg")))
    box = root["viewBox"].split() if "viewBox" in root else [0, 0, root.get("width", "nan"), root.get("height", "nan")]
    try:
        numbers = [float(x) for x in box]
    except ValueError:
        raise PathError("the canvas is not given by four numbers") from None
    if len(numbers) != 4 or not all(map(math.isfinite, numbers)) or "d" not in given:
        raise PathError("the canvas is not given by four numbers" if "d" in given else "the path is not drawn")
    return given["d"], numbers


def winding(loop: np.ndarray, side: int = 96) -> np.ndarray:
    """How often a closed polygon winds around each of side x side sample points. loop: (n, 2)."""
    at = (np.arange(side) + 0.5) * SIDE / side
    x, y = np.meshgrid(at, at - SIDE)
    turns = np.zeros((side, side), dtype=np.int32)
    for (x0, y0), (x1, y1) in zip(loop, np.roll(loop, -1, axis=0)):
        if y0 != y1:
            crosses = (y >= min(y0, y1)) & (y < max(y0, y1)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
            turns += np.where(crosses, 1 if y1 > y0 else -1, 0)
    return turns


def raster(d: str, side: int = 96, steps: int = 8) -> np.ndarray:
    """Samples inside the path's polygons, curves flattened to steps pieces each; by the non-zero rule over all of them."""
    loops, pen, start, control = [], (0.0, 0.0), (0.0, 0.0), None
    for kind, p in absolute(d):
        if kind == "Z":
            pen, control = start, None
            continue
        if kind == "M":
            loops.append([p[0]])
            start = p[0]
        elif kind in "QT":
            c = p[0] if kind == "Q" else (2 * pen[0] - control[0], 2 * pen[1] - control[1]) if control else pen
            for k in range(1, steps + 1):
                t = k / steps
                loops[-1].append(tuple((1 - t) ** 2 * a + 2 * t * (1 - t) * b + t * t * e for a, b, e in zip(pen, c, p[-1])))
        else:
            loops[-1].append(p[-1])
        control = c if kind in "QT" else None
        pen = p[-1]
    return sum((winding(np.array(loop), side) for loop in loops), np.zeros((side, side), dtype=np.int32)) != 0


def _texts(f, *args):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda d: None if d is None else f(d, *args))

    return run


def quantize(d: Column, grid: float = SIDE) -> Column:
    return F.pandas_udf(_texts(quantized, grid), "string")(d)


def canvas_error(d: Column) -> Column:
    return F.pandas_udf(_texts(outside), "string")(d)


def all_points(d: Column) -> Column:
    """Coordinates one after the other, x before y."""
    return F.pandas_udf(_texts(lambda s: [v for xy in points(s) for v in xy]), "array<double>")(d)


def from_svg(text: Column) -> Column:
    """Struct of d, normalized, and error; one of d and error is null."""

    def one(s: str) -> tuple:
        try:
            d, box = svg(s)
            return normalized(d, box), None
        except PathError as e:
            return None, str(e)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([one(s or "") for s in batch], columns=["d", "error"], dtype=object)

    return F.pandas_udf(run, "d string, error string")(text)
