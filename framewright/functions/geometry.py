"""Boxes, canvases, scales and weights as Column expressions; all doubles unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low) if not isinstance(low, Column) else low), F.lit(high) if not isinstance(high, Column) else high)


def clamp_frame(index: Column, total: Column) -> Column:
    """Into [0, total - 1]; without a total only from below."""
    return F.when(total <= 0, F.greatest(index, F.lit(0))).otherwise(clamp(index, 0, total - 1))


def proxy_size(width: Column, height: Column, longest: int = 1080) -> tuple[Column, Column]:
    """Scaled so that the long edge is at most `longest`, then rounded down to even, two at least."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    even = lambda v: F.greatest(F.lit(2), (F.floor(v * scale + 0.5) - F.floor(v * scale + 0.5) % 2)).cast("int")
    return even(width), even(height)


def letterbox(width: Column, height: Column, to_w: int = 640, to_h: int = 640) -> dict[str, Column]:
    """A null scale, and null sizes, for an image without width or height."""
    scale = F.least(F.try_divide(F.lit(float(to_w)), F.when(width > 0, width)), F.try_divide(F.lit(float(to_h)), F.when(height > 0, height)))
    scale = F.when((width > 0) & (height > 0), scale)
    w, h = F.floor(width * scale + 0.5).cast("int"), F.floor(height * scale + 0.5).cast("int")
    half = lambda room: F.floor((room) / 2).cast("int")
    return {"scale": scale, "new_w": w, "new_h": h, "pad_x": half(F.lit(to_w) - w), "pad_y": half(F.lit(to_h) - h)}


def unletterbox(cx: Column, cy: Column, w: Column, h: Column, scale: Column, pad_x: Column, pad_y: Column, src_w: Column, src_h: Column) -> dict[str, Column]:
    """A centre box in the padded input as corners in the source image, clamped to it."""
    at = lambda v, pad, dim: clamp((v - pad) / scale, 0.0, (dim - 1).cast("double"))
    return {"x1": at(cx - w / 2, pad_x, src_w), "y1": at(cy - h / 2, pad_y, src_h), "x2": at(cx + w / 2, pad_x, src_w), "y2": at(cy + h / 2, pad_y, src_h)}


def integer_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column) -> dict[str, Column]:
    """The smallest box of whole pixels around the corners, cut to the image: x, y, w, h."""
    left, top = F.greatest(F.lit(0), F.floor(x1)), F.greatest(F.lit(0), F.floor(y1))
    right, bottom = F.least(width, F.ceil(x2)), F.least(height, F.ceil(y2))
    size = lambda a, b: F.greatest(F.lit(0), b - a).cast("int")
    return {"x": left.cast("int"), "y": top.cast("int"), "w": size(left, right), "h": size(top, bottom)}


def area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two corner boxes; 0 where the union is empty."""
    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - both
    return F.when(union <= 0, 0.0).otherwise(both / F.when(union <= 0, 1.0).otherwise(union))


def sigmoid(x: Column) -> Column:
    """Without overflow for either sign."""
    return F.when(x >= 0, 1 / (1 + F.exp(-F.abs(x)))).otherwise(F.exp(-F.abs(x)) / (1 + F.exp(-F.abs(x))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def binarise(mask: Column, threshold: float = 0.5) -> Column:
    return F.transform(mask, lambda v: F.when(v >= threshold, 255).otherwise(0))


def crop(mask: Column, width: int, x: int, y: int, w: int, h: int) -> Column:
    """The cells of a mask (rows of `width` cells, one array) that lie in a box."""
    inside = lambda i: (i % width >= x) & (i % width < x + w) & (F.floor(i / width) >= y) & (F.floor(i / width) < y + h)
    return F.filter(mask, lambda v, i: inside(i))


def sigma_weight(sigma: Column) -> Column:
    """1 / sigma^2, where sigma is 1e-3 if it is not positive and finite."""
    usable = F.when((sigma > 0) & ~F.isnan(sigma) & (sigma < float("inf")), sigma).otherwise(1e-3)
    return 1 / (usable * usable)


def huber_weight(residual: Column, delta: float = 6.0) -> Column:
    d = max(delta, 1e-6)
    odd = F.isnan(residual) | (residual == float("inf")) | residual.isNull()
    return F.when(odd | (residual <= d), 1.0).otherwise(d / F.when(residual <= d, 1.0).otherwise(residual))


def source_shift(delta: Column, source: Column, proxy: Column) -> Column:
    """Null where the proxy has no size."""
    return -delta * F.try_divide(source.cast("double"), proxy)


def blend_weights(offset: Column) -> tuple[Column, Column]:
    """Of 256 parts, those of the next and of the nearer pixel for a sub-pixel offset."""
    far = clamp(F.floor((F.ceil(offset) - offset) * 256 + 0.5), 0, 256).cast("int")
    return far, F.lit(256) - far


def visible_span(offset: Column, size: Column, canvas: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), F.ceil(offset)).cast("int"), F.least(canvas - 1, F.floor(offset + size - 1)).cast("int")


def blend(near: Column, far: Column, w_near: Column, w_far: Column) -> Column:
    """One axis of the fixed-point mix of two samples, in 1/65536 after the second axis."""
    return near * w_near + far * w_far


def fit_into(width: Column, height: Column, box_w: Column, box_h: Column) -> dict[str, Column]:
    """The largest centred rectangle of the image's shape in a box; all 0 for an image without width or height."""
    there = (width > 0) & (height > 0)
    scale = F.least(F.try_divide(box_w, width), F.try_divide(box_h, height))
    w, h = width * scale, height * scale
    sides = {"x": (box_w - w) / 2, "y": (box_h - h) / 2, "w": w, "h": h}
    return {k: F.when(there, v).otherwise(0.0) for k, v in sides.items()}


def clicked(x: Column, y: Column, shown: dict[str, Column]) -> dict[str, Column]:
    """A click as parts of the image's width and height, 0 to 1, where `shown` (fit_into) is drawn; null beside it."""
    inside = (shown["w"] > 0) & (shown["h"] > 0) & x.between(shown["x"], shown["x"] + shown["w"]) & y.between(shown["y"], shown["y"] + shown["h"])
    part = lambda v, start, size: F.when(inside, clamp(F.try_divide(v - start, size), 0.0, 1.0))
    return {"x": part(x, shown["x"], shown["w"]), "y": part(y, shown["y"], shown["h"])}


def in_widget(x: Column, y: Column, shown: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """A point of the image where it is drawn; null for an image without width or height."""
    return {"x": shown["x"] + x * F.try_divide(shown["w"], width), "y": shown["y"] + y * F.try_divide(shown["h"], height)}


def rational(num: Column, den: Column) -> Column:
    return F.when((num == 0) | (den == 0), 0.0).otherwise(num / F.when(den == 0, 1).otherwise(den))


def frame_bytes(pixel_format: Column, width: Column, height: Column) -> Column:
    """Bytes of a frame; 0 without width or height. A format that is not known counts as one of 12 bits a pixel."""
    w, h = width.cast("long"), height.cast("long")
    n, half_w, half_h = w * h, F.floor((w + 1) / 2), F.floor((h + 1) / 2)
    known = [  # bytes by format, fixed
        (("yuv420p10", "p010", "rgb24", "bgr24", "yuv444p"), n * 3), (("rgba", "bgra", "argb", "abgr"), n * 4), (("gray",), n), (("gray10", "gray16"), n * 2),
        (("nv12", "nv21"), n + half_w * half_h * 2), (("yuv422p",), n + half_w * h * 2),
    ]
    size = F.floor(n * 3 / 2)
    for names, own in known:
        size = F.when(pixel_format.isin(*names), own).otherwise(size)
    return F.when((w > 0) & (h > 0), size).otherwise(0).cast("long")


def black_level(pixel_format: Column) -> tuple[Column, Column]:
    """Luma and chroma of black, limited range; fixed values."""
    luma = F.when(pixel_format == "p010", 64 * 64).when(pixel_format == "yuv420p10", 64).otherwise(16)
    chroma = F.when(pixel_format == "p010", 512 * 64).when(pixel_format == "yuv420p10", 512).otherwise(128)
    return luma.cast("int"), chroma.cast("int")


def input_edge(shape_edge: Column, values: Column) -> Column:
    """A model's square input edge: its shape's, else the root of a third of the value count, rounded down, where that is whole, else null."""
    plane = F.floor(values / 3)
    root = F.round(F.sqrt(F.greatest(plane, F.lit(0)))).cast("long")
    return F.when(shape_edge > 0, shape_edge).when((values >= 0) & (root * root == plane), root).cast("int")


def first_supported(preferred: list[str], available: Column) -> Column:
    return F.get(F.filter(F.array(*map(F.lit, preferred)), lambda p: F.array_contains(available, p)), F.lit(0))


def copy_rectangle(x: Column, y: Column, w: Column, h: Column, to_w: Column, to_h: Column) -> dict[str, Column]:
    """The part of a w x h image put at (x, y) that lies on the target."""
    left, top = F.greatest(x, F.lit(0)), F.greatest(y, F.lit(0))
    size = lambda a, end: F.greatest(F.lit(0), end - a).cast("int")
    return {"left": left.cast("int"), "top": top.cast("int"), "w": size(left, F.least(x + w, to_w)), "h": size(top, F.least(y + h, to_h))}


def to_frame(points: Column, left: Column, top: Column) -> Column:
    """An array of points (x, y) of a region, in the coordinates of the frame that the region lies in."""
    return F.transform(points, lambda p: F.struct((p["x"] + left).alias("x"), (p["y"] + top).alias("y")))
