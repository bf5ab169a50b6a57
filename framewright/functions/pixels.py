"""Small images held as arrays (rows of cells, one behind the other) as Column expressions: resampling, cutting, the mask chain, sub-pixel copies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as g


def _int(x) -> Column:
    return x.cast("int") if isinstance(x, Column) else F.lit(x).cast("int")


def _let(values: dict[str, Column], f) -> Column:
    """f of the values, each computed once for a row and not once for each cell."""
    return F.get(F.transform(F.array(F.struct(*(v.alias(k) for k, v in values.items()))), lambda s: f(*(s[k] for k in values))), F.lit(0))


def _cells(n: Column) -> Column:
    """0 to n - 1; none for n = 0."""
    return F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: i < n)


def _line(at: Column, size: Column, to: Column) -> tuple[Column, Column, Column]:
    """The two cells of a line of `size` that cell `at` of `to` lies between, by the centres of the cells, and the second one's share."""
    place = (at + 0.5) * (size.cast("double") / to) - 0.5
    first = F.floor(place).cast("int")
    inside = (first >= 0) & (first < size - 1)
    near = g.clamp(first, F.lit(0), size - 1)
    return near, F.least(near + 1, size - 1), F.when(inside, place - first).otherwise(0.0)


def resize(image: Column, width, height, to_width, to_height) -> Column:
    """The image at another size by bilinear interpolation between the centres of its cells; beyond the outer ones their value holds."""

    def resized(image: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> Column:
        across = F.transform(_cells(to_w), lambda x: F.struct(*(c.alias(n) for n, c in zip("abf", _line(x, w, to_w)))))
        down = F.transform(_cells(to_h), lambda y: F.struct(*(c.alias(n) for n, c in zip("abf", _line(y, h, to_h)))))

        def cell(x: Column, y: Column) -> Column:
            row = lambda at: F.get(image, at * w + x["a"]) * (1 - x["f"]) + F.get(image, at * w + x["b"]) * x["f"]
            return row(y["a"]) * (1 - y["f"]) + row(y["b"]) * y["f"]

        return _let({"across": across}, lambda across: F.flatten(F.transform(down, lambda y: F.transform(across, lambda x: cell(x, y)))))

    return _let({"image": image, "w": _int(width), "h": _int(height), "to_w": _int(to_width), "to_h": _int(to_height)}, resized)


def cut(image: Column, width, height, x, y, w, h) -> Column:
    """The part of the image that lies in a box, row by row; the box is cut to the image first."""

    def part(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
        inside = lambda i: (i % width >= x) & (i % width < x + w) & (F.floor(i / width) >= y) & (F.floor(i / width) < y + h) & (i < width * height)
        return F.filter(image, lambda _, i: inside(i))

    return _let({k: _int(v) for k, v in (("width", width), ("height", height), ("x", x), ("y", y), ("w", w), ("h", h))}, part)


def mask(logits: Column, width: int, height: int, input_size: int, box: dict[str, Column], src_w: Column, src_h: Column, x: Column, y: Column, w: Column, h: Column, threshold: float = 0.5) -> Column:
    """The 0 / 255 mask of a detection: logits of width x height cells to shares, resized to the model's square input, freed of the
    padding of `box` (geometry.letterbox), resized to the source, binarised and cut to the detection's box; no cells for an empty box.
    """
    shares = F.transform(logits, lambda v: g.sigmoid(v.cast("double")))
    whole = resize(shares, width, height, input_size, input_size)
    inner_w, inner_h = F.least(box["new_w"], F.lit(input_size) - box["pad_x"]), F.least(box["new_h"], F.lit(input_size) - box["pad_y"])
    bare = cut(whole, input_size, input_size, box["pad_x"], box["pad_y"], inner_w, inner_h)
    return F.when((w > 0) & (h > 0), cut(g.binarise(resize(bare, inner_w, inner_h, src_w, src_h), threshold), src_w, src_h, x, y, w, h))


def blit(plane: Column, width, height, to: Column, to_width, to_height, at_x: Column, at_y: Column, channels: int = 1) -> Column:
    """`to` with the plane put at a place that need not be whole: each cell is mixed from four by 1/256 weights, rounded at the end.

    Neighbours beyond the plane are its last cells. Cells of several channels stand together. Values of up to 16 bits.
    """
    wx1, wx0 = g.blend_weights(at_x)
    wy1, wy0 = g.blend_weights(at_y)
    width, height, to_width, to_height = map(_int, (width, height, to_width, to_height))
    span = lambda at, size, room: dict(zip(("first", "last"), g.visible_span(at, size, room)))
    across, down = span(at_x, width, to_width), span(at_y, height, to_height)
    numbers = {"wx0": wx0, "wx1": wx1, "wy0": wy0, "wy1": wy1, "w": width, "h": height, "to_w": to_width, "cx": F.ceil(at_x).cast("int"), "cy": F.ceil(at_y).cast("int"), **{f"x_{k}": v for k, v in across.items()}, **{f"y_{k}": v for k, v in down.items()}}

    def put(plane: Column, *values: Column) -> Column:
        n = dict(zip(numbers, values))
        near = lambda v, size: (lambda first: (first, F.least(first + 1, size - 1)))(g.clamp(v, F.lit(0), size - 1))

        def cell(old: Column, i: Column) -> Column:
            c, x, y = i % channels, F.floor(i / channels).cast("int") % n["to_w"], F.floor(i / (n["to_w"] * channels)).cast("int")
            xs, ys = near(x - n["cx"], n["w"]), near(y - n["cy"], n["h"])
            p = lambda row, column: F.get(plane, (row * n["w"] + column) * channels + c).cast("long")
            row = lambda y: g.blend(p(y, xs[0]), p(y, xs[1]), n["wx0"], n["wx1"])
            mixed = F.shiftright(g.blend(row(ys[0]), row(ys[1]), n["wy0"], n["wy1"]) + 32768, 16)
            inside = (x >= n["x_first"]) & (x <= n["x_last"]) & (y >= n["y_first"]) & (y <= n["y_last"])
            return F.when(inside, mixed).otherwise(old).cast("int")

        return F.transform(to, cell)

    return _let({"plane": plane, **numbers}, put)
