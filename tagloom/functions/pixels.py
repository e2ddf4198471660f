"""NumPy kernels for one image; Spark partitions and batches the images.

Pixel buffers are row-major ``height x width x channels`` bytes in the channel
order of Spark's image source (gray, BGR or BGRA).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# fixed values: integer luma weights for red, green, blue, out of 10000
LUMA_WEIGHTS = (2126, 7152, 722)
# fixed values: multiplier and increment of the noise generator
LCG_MULTIPLIER = 6364136223846793005
LCG_INCREMENT = 1442695040888963407


def to_array(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), int(channels))


def to_rgb(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return np.repeat(img, 3, axis=2)
    return img[:, :, 2::-1]


def to_luma(img: np.ndarray) -> np.ndarray:
    if img.shape[2] == 1:
        return img[:, :, 0]
    rgb = to_rgb(img).astype(np.uint32)
    return (rgb @ np.array(LUMA_WEIGHTS, dtype=np.uint32) // 10000).astype(np.uint8)


def _lanczos3(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3.0, np.sinc(x) * np.sinc(x / 3.0), 0.0)


def _weights(n_in: int, n_out: int, kernel, support: float) -> np.ndarray:
    """``n_out x n_in`` resampling matrix; rows sum to one."""
    step = n_in / n_out
    spread = max(step, 1.0)
    centers = (np.arange(n_out) + 0.5) * step
    taps = np.arange(n_in)
    lo = np.clip(np.floor(centers - support * spread), 0, n_in - 1)
    hi = np.clip(np.ceil(centers + support * spread), lo + 1, n_in)
    w = kernel((taps[None, :] - (centers[:, None] - 0.5)) / spread)
    w = np.where((taps[None, :] >= lo[:, None]) & (taps[None, :] < hi[:, None]), w, 0.0)
    return w / w.sum(axis=1, keepdims=True)


def _resample(img: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    h, w, c = img.shape
    out = (rows @ img.reshape(h, w * c).astype(np.float64)).reshape(len(rows), w, c)
    out = np.matmul(cols, out)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def resize(img: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w, _ = img.shape
    if (h, w) == (height, width):
        return img
    return _resample(img, _weights(h, height, _lanczos3, 3.0), _weights(w, width, _lanczos3, 3.0))


def blur(img: np.ndarray, radius: float) -> np.ndarray:
    """Gaussian blur, sigma at least 0.1; a radius of zero is off."""
    if radius <= 0:
        return img
    sigma = max(radius, 0.1)
    h, w, _ = img.shape

    def bell(x):
        return np.exp(-(x * x) / (2.0 * sigma * sigma))

    return _resample(img, _weights(h, h, bell, 2.0 * sigma), _weights(w, w, bell, 2.0 * sigma))


def signed64(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def dhash(luma: np.ndarray) -> int:
    small = resize(luma[:, :, None], 9, 8)[:, :, 0]
    falls = (small[:, :8] > small[:, 1:]).ravel()
    return signed64(sum(1 << i for i in np.flatnonzero(falls).tolist()))


def phash(luma: np.ndarray) -> int:
    """Sign of 63 low DCT-II terms against their upper median."""
    n = 32
    small = resize(luma[:, :, None], n, n)[:, :, 0].astype(np.float64)
    basis = np.cos((2 * np.arange(n)[None, :] + 1) * np.arange(8)[:, None] * np.pi / (2 * n))
    low = (basis @ small @ basis.T).ravel()[1:]
    above = low > np.sort(low)[31]
    return signed64(sum(1 << i for i in np.flatnonzero(above).tolist()))


def rgb_histogram(img: np.ndarray) -> np.ndarray:
    """16 bins per channel, red then green then blue, each over the pixel count."""
    rgb = to_rgb(img).reshape(-1, 3) >> 4
    bins = np.concatenate([np.bincount(rgb[:, c], minlength=16) for c in range(3)])
    return bins / float(len(rgb))


def flip(img: np.ndarray, mode: str) -> np.ndarray:
    if mode == "horizontal":
        return img[:, ::-1]
    if mode == "vertical":
        return img[::-1]
    if mode == "both":
        return img[::-1, ::-1]
    raise ValueError(f"unknown flip mode {mode!r}")


def crop(img: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    return img[int(y) : int(y + h), int(x) : int(x + w)]


def is_transparent(img: np.ndarray) -> bool:
    return img.shape[2] == 4 and bool((img[:, :, 3] < 255).any())


def flatten_alpha(img: np.ndarray, background: str) -> np.ndarray:
    """Blend onto white or black, truncating; opaque images stay as they are."""
    if not is_transparent(img):
        return img
    back = np.float32(255.0 if background == "white" else 0.0)
    alpha = img[:, :, 3:4].astype(np.float32) / np.float32(255.0)
    return (img[:, :, :3].astype(np.float32) * alpha + back * (np.float32(1.0) - alpha)).astype(np.uint8)


def path_seed(path: str) -> int:
    """Polynomial hash (base 31) of the UTF-8 bytes, wrapping at 64 bits."""
    data = np.frombuffer(path.encode("utf-8"), dtype=np.uint8).astype(np.uint64)
    if not len(data):
        return 0
    powers = np.ones(len(data), dtype=np.uint64)
    np.multiply.accumulate(np.full(len(data) - 1, 31, dtype=np.uint64), out=powers[1:])
    with np.errstate(over="ignore"):
        return int((data * powers[::-1]).sum(dtype=np.uint64))


def noise(img: np.ndarray, strength: int, seed: int) -> np.ndarray:
    """Seeded Gaussian noise on the color channels, pixel by pixel, R then G then B.

    All generator states are produced at once: the k-th state is an affine
    function of the seed whose factors are running products and sums.
    """
    if strength <= 0:
        return img
    h, w, c = img.shape
    draws = h * w * 3 * 2
    with np.errstate(over="ignore"):
        factor = np.multiply.accumulate(np.full(draws, LCG_MULTIPLIER, dtype=np.uint64))
        offset = np.concatenate([[np.uint64(1)], factor[:-1]]).cumsum(dtype=np.uint64) * np.uint64(LCG_INCREMENT)
        states = factor * np.uint64(seed) + offset
    unit = (states >> np.uint64(33)).astype(np.float64) / float(1 << 31)
    u1, u2 = np.maximum(unit[0::2], 1e-10), unit[1::2]
    bell = (np.sqrt(-2.0 * np.log(u1)) * np.cos(2.0 * np.pi * u2)).reshape(h, w, 3)
    rgb = to_rgb(img).astype(np.float64) + bell * strength
    rgb = np.clip(np.trunc(rgb + np.copysign(0.5, rgb)), 0, 255).astype(np.uint8)
    out = np.full((h, w, 4), 255, dtype=np.uint8)
    out[:, :, :3] = rgb[:, :, ::-1]
    if c == 4:
        out[:, :, 3] = img[:, :, 3]
    return out


def corners(variant: int, d: float) -> np.ndarray:
    """Where the unit square's corners land: pinched at the top, bottom, left or right."""
    square = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])
    edge, depth = {
        0: ((0, 1), (0.0, 1.0)),
        1: ((3, 2), (0.0, -1.0)),
        2: ((0, 3), (1.0, 0.0)),
        3: ((1, 2), (-1.0, 0.0)),
    }[variant]
    a, b = edge
    along = square[b] - square[a]
    shift = np.array(depth) * d * 0.5
    square[a], square[b] = square[a] + along * d + shift, square[b] - along * d + shift
    return square


def homography(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """The 3x3 projective map taking four ``src`` points to ``dst``."""
    rows, rhs = [], []
    for (x, y), (u, v) in zip(src, dst):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        rhs += [u, v]
    try:
        h = np.linalg.solve(np.array(rows, dtype=np.float64), np.array(rhs, dtype=np.float64))
    except np.linalg.LinAlgError:
        return np.eye(3)
    return np.append(h, 1.0).reshape(3, 3)


def perspective(img: np.ndarray, intensity: float, variant: int) -> np.ndarray:
    """Inverse-mapped projective warp, bilinear; outside the source is transparent."""
    h, w, c = img.shape
    if c == 4:
        rgba = img
    else:
        bgr = img if c == 3 else np.repeat(img, 3, axis=2)
        rgba = np.dstack([bgr, np.full((h, w), 255, dtype=np.uint8)])
    unit = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])
    back = homography(corners(variant, intensity), unit)
    gx, gy = np.meshgrid(np.arange(w) / w, np.arange(h) / h)
    px, py, pz = np.tensordot(back, np.stack([gx, gy, np.ones_like(gx)]), axes=1)
    ok = np.abs(pz) >= 1e-10
    pz = np.where(ok, pz, 1.0)
    sx, sy = px / pz * w, py / pz * h
    ok &= (sx >= 0) & (sx < w - 1) & (sy >= 0) & (sy < h - 1)
    sx, sy = np.where(ok, sx, 0.0), np.where(ok, sy, 0.0)
    x0, y0 = np.floor(sx).astype(int), np.floor(sy).astype(int)
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = (sx - x0)[..., None], (sy - y0)[..., None]
    src = rgba.astype(np.float64)
    mixed = (src[y0, x0] * (1 - fx) + src[y0, x1] * fx) * (1 - fy) + (src[y1, x0] * (1 - fx) + src[y1, x1] * fx) * fy
    return np.where(ok[..., None], np.clip(np.floor(mixed + 0.5), 0, 255), 0).astype(np.uint8)


def eight_views(img: np.ndarray) -> list[np.ndarray]:
    """Two mirrorings times four quarter turns."""
    return [np.rot90(base, k) for base in (img, img[:, ::-1]) for k in range(4)]


def undo_view(index: int, img: np.ndarray) -> np.ndarray:
    turned = np.rot90(img, -(index % 4))
    return turned[:, ::-1] if index >= 4 else turned


def encode_png(img: np.ndarray) -> bytes:
    h, w, c = img.shape
    order = {1: img, 3: img[:, :, ::-1], 4: img[:, :, [2, 1, 0, 3]] if c == 4 else img}[c]
    raw = np.concatenate([np.zeros((h, 1), dtype=np.uint8), order.reshape(h, -1)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_bmp(img: np.ndarray) -> bytes:
    h, w, _ = img.shape
    bgr = to_rgb(img)[:, :, ::-1]
    row = bgr.reshape(h, -1)[::-1]
    body = np.pad(row, ((0, 0), (0, -row.shape[1] % 4))).tobytes()
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0)
    return b"BM" + struct.pack("<IHHI", 14 + len(info) + len(body), 0, 0, 14 + len(info)) + info + body
