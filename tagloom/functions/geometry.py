"""Size arithmetic as columns: buckets, crops, scaling, letterboxes, tiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(value: Column | int | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def whole(x: Column) -> Column:
    """Truncate a non-negative number to an integer."""
    return F.floor(x).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def round_to_steps(x: Column, steps: Column | int) -> Column:
    """Round half up, align down to a multiple of ``steps``, at least one step."""
    s = _c(steps).cast("long")
    v = half_up(x)
    return F.greatest(v - v % s, s)


def ratio(w: Column, h: Column) -> Column:
    return w.cast("double") / h.cast("double")


def _two_roundings(w: Column, h: Column, area: Column | float, steps: Column | int, floor: Column | int):
    """Width-first and height-first aligned sizes for an area-preserving target."""
    aspect = ratio(w, h)
    tw = F.sqrt(_c(area) * aspect)
    th = _c(area) / tw
    low = _c(floor).cast("long")
    w1 = F.greatest(round_to_steps(tw, steps), low)
    h1 = F.greatest(round_to_steps(w1 / aspect, steps), low)
    h2 = F.greatest(round_to_steps(th, steps), low)
    w2 = F.greatest(round_to_steps(h2 * aspect, steps), low)
    return aspect, (w1, h1), (w2, h2)


def nearest_bucket(w: Column, h: Column, area: Column | float, steps: Column | int, min_size: Column | int) -> Column:
    """The aligned size closest in aspect; equal errors favour the width first."""
    floor = F.greatest(_c(steps).cast("long"), _c(min_size).cast("long"))
    aspect, (w1, h1), (w2, h2) = _two_roundings(w, h, area, steps, floor)
    first = F.abs(ratio(w1, h1) - aspect) <= F.abs(ratio(w2, h2) - aspect)
    return F.struct(F.when(first, w1).otherwise(w2).alias("bw"), F.when(first, h1).otherwise(h2).alias("bh"))


def no_upscale_bucket(w: Column, h: Column, area: Column | float, steps: Column | int) -> Column:
    """Shrink to the area when too large, then align down; never enlarge.

    Here equal errors favour the height first, unlike :func:`nearest_bucket`.
    """
    s = _c(steps).cast("long")
    aspect, (w1, h1), (w2, h2) = _two_roundings(w, h, area, steps, 0)
    first = F.abs(ratio(w1, h1) - aspect) < F.abs(ratio(w2, h2) - aspect)
    big = w.cast("double") * h.cast("double") > _c(area)
    rw = F.when(~big, w.cast("long")).when(first, w1).otherwise(half_up(h2 * aspect))
    rh = F.when(~big, h.cast("long")).when(first, half_up(w1 / aspect)).otherwise(h2)
    return F.struct(F.greatest(rw - rw % s, s).alias("bw"), F.greatest(rh - rh % s, s).alias("bh"))


def _rect(x, y, w, h, status) -> Column:
    return F.struct(
        _c(x).cast("long").alias("x"),
        _c(y).cast("long").alias("y"),
        _c(w).cast("long").alias("w"),
        _c(h).cast("long").alias("h"),
        _c(status).alias("status"),
    )


def crop_center(w: Column, h: Column, target_w: int, target_h: int) -> Column:
    tw, th = F.least(F.lit(target_w), w), F.least(F.lit(target_h), h)
    status = F.when((tw == w) & (th == h), "skip").otherwise("crop")
    return _rect(F.floor((w - tw) / 2), F.floor((h - th) / 2), tw, th, status)


def crop_aspect(w: Column, h: Column, target: float, tolerance: float = 0.01) -> Column:
    """Trim the longer side to the wanted ratio; near enough is left alone."""
    if target <= 0:
        return _rect(0, 0, w, h, "error")
    now = ratio(w, h)
    close = F.abs(now - F.lit(target)) < tolerance
    wide = now > F.lit(target)
    tw = F.when(close | ~wide, w).otherwise(F.least(whole(h * F.lit(target)), w))
    th = F.when(close | wide, h).otherwise(F.least(whole(w / F.lit(target)), h))
    return _rect(F.floor((w - tw) / 2), F.floor((h - th) / 2), tw, th, F.when(close, "skip").otherwise("crop"))


def crop_edges(w: Column, h: Column, top: int, bottom: int, left: int, right: int) -> Column:
    too_much = (F.lit(top + bottom) >= h) | (F.lit(left + right) >= w)
    idle = top == bottom == left == right == 0
    status = F.when(too_much, "error").otherwise("skip" if idle else "crop")
    return _rect(
        F.when(too_much, 0).otherwise(left),
        F.when(too_much, 0).otherwise(top),
        F.when(too_much, w).otherwise(w - (left + right)),
        F.when(too_much, h).otherwise(h - (top + bottom)),
        status,
    )


def _area_scaled(w: Column, h: Column, tw: int, th: int, align: int = 64) -> tuple[Column, Column]:
    scale = F.sqrt(F.lit(float(tw) * float(th)) / (w.cast("double") * h.cast("double")))

    def side(v: Column) -> Column:
        return F.greatest(half_up(v * scale / align) * align, F.lit(align)).cast("long")

    return side(w), side(h)


def scale_size(
    w: Column, h: Column, mode: str, up: tuple[int, int], down: tuple[int, int] | None = None
) -> Column:
    """Area-preserving resize plan: ``(w, h, status)`` with sides in 64s.

    ``up`` raises images with a side below it, ``down`` lowers those with a side
    above it; ``both`` runs the two steps one after the other.
    """
    if mode not in ("upscale", "downscale", "both"):
        raise ValueError(f"unknown scale mode {mode!r}")
    down = down or up
    cw, ch, changed = w.cast("long"), h.cast("long"), F.lit(False)
    if mode in ("upscale", "both"):
        hit = (cw < up[0]) | (ch < up[1])
        nw, nh = _area_scaled(cw, ch, *up)
        cw, ch, changed = F.when(hit, nw).otherwise(cw), F.when(hit, nh).otherwise(ch), changed | hit
    if mode in ("downscale", "both"):
        target = down if mode == "both" else up
        hit = (cw > target[0]) | (ch > target[1])
        nw, nh = _area_scaled(cw, ch, *target)
        cw, ch, changed = F.when(hit, nw).otherwise(cw), F.when(hit, nh).otherwise(ch), changed | hit
    return F.struct(cw.alias("w"), ch.alias("h"), F.when(changed, "resize").otherwise("skip").alias("status"))


def letterbox(w: Column, h: Column, size: int) -> Column:
    """Fit into a square canvas: scale, fitted size and centred padding."""
    scale = F.least(F.lit(float(size)) / w, F.lit(float(size)) / h)
    nw, nh = whole(w * scale), whole(h * scale)
    return F.struct(
        scale.alias("scale"),
        nw.alias("w"),
        nh.alias("h"),
        F.floor((size - nw) / 2).cast("long").alias("pad_x"),
        F.floor((size - nh) / 2).cast("long").alias("pad_y"),
    )


def pad_square(w: Column, h: Column) -> Column:
    """Pad the shorter side to a square, the image in the middle."""
    side = F.greatest(w, h).cast("long")
    return F.struct(
        side.alias("side"),
        F.floor((side - w) / 2).cast("long").alias("pad_left"),
        F.floor((side - h) / 2).cast("long").alias("pad_top"),
    )


def fit_max_side(w: Column, h: Column, limit: int = 1024) -> Column:
    """Shrink so that no side exceeds ``limit``, keeping the aspect."""
    big = (w > limit) | (h > limit)
    scale = F.least(F.lit(float(limit)) / w, F.lit(float(limit)) / h)
    nw = F.greatest(half_up(w * scale), F.lit(1))
    nh = F.greatest(half_up(h * scale), F.lit(1))
    return F.struct(F.when(big, nw).otherwise(w.cast("long")).alias("w"), F.when(big, nh).otherwise(h.cast("long")).alias("h"))


def tiles(w: Column, h: Column, tile: int, pad: int = 10, scale: int = 1) -> Column:
    """Array of overlapping tiles: padded input window, valid crop, output window."""
    if tile <= 0:
        whole_image = F.struct(
            *[F.lit(0).cast("long").alias(n) for n in ("tile_x", "tile_y", "in_x0", "in_y0")],
            w.cast("long").alias("in_x1"), h.cast("long").alias("in_y1"),
            F.lit(0).cast("long").alias("crop_x0"), F.lit(0).cast("long").alias("crop_y0"),
            (w * scale).cast("long").alias("crop_x1"), (h * scale).cast("long").alias("crop_y1"),
            F.lit(0).cast("long").alias("out_x0"), F.lit(0).cast("long").alias("out_y0"),
            (w * scale).cast("long").alias("out_x1"), (h * scale).cast("long").alias("out_y1"),
        )
        return F.array(whole_image)

    def axis(length: Column, i: Column):
        start = i * tile
        lo = F.greatest(start - pad, F.lit(0))
        hi = F.least(start + tile + pad, length)
        crop0 = (start - lo) * scale
        crop1 = crop0 + F.least(F.lit(tile), length - start) * scale
        return lo, hi, crop0, crop1, start * scale, F.least(start * scale + tile * scale, length * scale)

    def one(ix: Column, iy: Column) -> Column:
        x = axis(w, ix)
        y = axis(h, iy)
        names = ("in_{}0", "in_{}1", "crop_{}0", "crop_{}1", "out_{}0", "out_{}1")
        parts = [v.cast("long").alias(n.format("x")) for n, v in zip(names, x)]
        parts += [v.cast("long").alias(n.format("y")) for n, v in zip(names, y)]
        return F.struct(ix.cast("long").alias("tile_x"), iy.cast("long").alias("tile_y"), *parts)

    nx, ny = F.ceil(w / tile).cast("int"), F.ceil(h / tile).cast("int")
    rows = F.transform(
        F.sequence(F.lit(0), ny - 1),
        lambda iy: F.transform(F.sequence(F.lit(0), nx - 1), lambda ix: one(ix, iy)),
    )
    return F.flatten(rows)
