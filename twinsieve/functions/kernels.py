"""NumPy kernels over decoded pictures and vectors; Arrow-based UDFs elsewhere call them batch by batch."""

from __future__ import annotations

import numpy as np


# Resampling -----------------------------------------------------------------------------------------------------


def _bicubic(x: np.ndarray) -> np.ndarray:
    x, a = np.abs(x), -0.5
    near = ((a + 2) * x - (a + 3)) * x * x + 1
    far = (((x - 5) * x + 8) * x - 4) * a
    return np.where(x < 1, near, np.where(x < 2, far, 0.0))


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)


def _bilinear(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1.0 - np.abs(x))


_FILTERS = {"bicubic": (_bicubic, 2.0), "lanczos": (_lanczos, 3.0), "bilinear": (_bilinear, 1.0)}


def resample_weights(n_in: int, n_out: int, kind: str = "bicubic", window: slice = slice(None)) -> np.ndarray:
    """Weights (n_out, n_in) of a separable filter that is widened when shrinking, so that it also smooths.

    With a window only the outputs in it have rows.
    """
    kernel, support = _FILTERS[kind]
    scale = n_in / n_out
    wide = max(scale, 1.0)
    centre = (np.arange(*window.indices(n_out))[:, None] + 0.5) * scale
    x = (np.arange(n_in)[None, :] + 0.5 - centre) / wide
    weights = np.where(np.abs(x) < support, kernel(x), 0.0)
    return weights / weights.sum(axis=1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, kind: str = "bicubic") -> np.ndarray:
    """Resize without keeping the aspect; values are rounded and clipped to bytes."""
    rows, cols = resample_weights(image.shape[0], height, kind), resample_weights(image.shape[1], width, kind)
    x = np.asarray(image, np.float64)
    out = np.einsum("oh,hw...->ow...", rows, x) if x.ndim == 3 else rows @ x
    out = np.einsum("pw,ow...->op...", cols, out) if x.ndim == 3 else out @ cols.T
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


# What networks trained on natural pictures expect of the red, green and blue channel.
CHANNEL_MEANS = (0.485, 0.456, 0.406)
CHANNEL_DEVIATIONS = (0.229, 0.224, 0.225)
#: Numbers that a matrix product of pictures holds at most.
PICTURE_NUMBERS = 1 << 24


def _shortened(height: int, width: int, short: int) -> tuple[int, int]:
    """The size at which the shorter side is ``short``, the other one cut to whole pixels."""
    return (short, int(short * width / height)) if height <= width else (int(short * height / width), short)


def network_input(pictures: list[np.ndarray], short: int = 256, crop: int = 224) -> np.ndarray:
    """BGR pictures as a batch (n, 3, crop, crop) of normalised red, green and blue planes.

    The shorter side becomes ``short`` by a bilinear filter that is widened when shrinking, the middle is cut out, bytes
    become 0 to 1 and are normalised by channel. Gray pictures (one channel or none) count as three equal ones, and
    a fourth channel is dropped. Pictures of one size go together through one matrix product a side, of the rows and
    columns that the cut keeps. A picture without pixels raises ValueError.
    """
    out = np.empty((len(pictures), 3, crop, crop), np.float32)
    by_size: dict[tuple[int, int], list[int]] = {}
    for i, picture in enumerate(pictures):
        if picture.ndim not in (2, 3) or not picture.size or (picture.ndim == 3 and picture.shape[2] == 2):
            raise ValueError("not a picture")
        by_size.setdefault(picture.shape[:2], []).append(i)
    for (height, width), members in by_size.items():
        tall, wide = _shortened(height, width, short)
        if min(tall, wide) < crop:
            raise ValueError("the cut is larger than the picture")
        top, left = round((tall - crop) / 2), round((wide - crop) / 2)
        rows = resample_weights(height, tall, "bilinear", slice(top, top + crop)).astype(np.float32)
        columns = resample_weights(width, wide, "bilinear", slice(left, left + crop)).astype(np.float32)
        at_once = max(1, PICTURE_NUMBERS // (3 * height * width))
        for at in range(0, len(members), at_once):
            part = members[at : at + at_once]
            planes = np.stack([_red_green_blue(pictures[i]) for i in part])
            cut = np.matmul(np.matmul(rows, planes), columns.T)
            out[part] = np.clip(np.floor(cut + 0.5), 0, 255) / 255
    means, deviations = (np.array(x, np.float32)[:, None, None] for x in (CHANNEL_MEANS, CHANNEL_DEVIATIONS))
    return (out - means) / deviations


def _red_green_blue(picture: np.ndarray) -> np.ndarray:
    """Planes (3, height, width) of a BGR picture."""
    x = picture[..., None] if picture.ndim == 2 else picture
    x = np.repeat(x[..., :1], 3, axis=2) if x.shape[2] == 1 else x[..., 2::-1]
    return x.transpose(2, 0, 1).astype(np.float32)


def gray(bgr: np.ndarray) -> np.ndarray:
    """Luma of a BGR picture."""
    return np.clip(np.floor(bgr[..., 2] * 0.299 + bgr[..., 1] * 0.587 + bgr[..., 0] * 0.114 + 0.5), 0, 255).astype(np.uint8)


# Hashes ---------------------------------------------------------------------------------------------------------


def pack_bits(bits: np.ndarray) -> np.ndarray:
    """Rows of up to 64 bits, first bit highest, as signed 64-bit integers."""
    out = np.zeros(len(bits), np.uint64)
    for column in np.asarray(bits, bool).T:
        out = (out << np.uint64(1)) | column.astype(np.uint64)
    return out.astype(np.int64)


def dct_matrix(n: int) -> np.ndarray:
    """Type-II discrete cosine transform, unscaled (factor 2)."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return 2 * np.cos(np.pi * k * (2 * i + 1) / (2 * n))


def haar_low(grids: np.ndarray) -> np.ndarray:
    """Remove the coarsest average: in an orthonormal Haar pyramid down to 1x1, the top band is the mean."""
    return grids - grids.mean(axis=(1, 2), keepdims=True)


def grid_hashes(grids: np.ndarray, method: str) -> np.ndarray:
    """Hashes of 8x8 grids: ahash, dhash (7 differences a row, 56 bits), phash and whash (64 bits)."""
    grids = np.asarray(grids, np.float64).reshape(-1, 8, 8)
    if method == "ahash":
        bits = grids > grids.mean(axis=(1, 2), keepdims=True)
    elif method == "dhash":
        bits = grids[:, :, 1:] > grids[:, :, :-1]
    elif method == "phash":
        d = dct_matrix(8)
        low = d @ grids @ d.T
        bits = low > np.median(low.reshape(len(low), -1), axis=1)[:, None, None]
    elif method == "whash":
        low = haar_low(grids)
        bits = low > np.median(low.reshape(len(low), -1), axis=1)[:, None, None]
    else:
        raise ValueError(f"no hash method: {method}")
    return pack_bits(bits.reshape(len(grids), -1))


def image_hash(bgr: np.ndarray, method: str) -> int:
    """64-bit hash of a picture."""
    g = gray(bgr)
    if method == "phash":
        small, d = resize(g, 32, 32, "lanczos").astype(np.float64), dct_matrix(32)
        low = (d @ small @ d.T)[:8, :8]
        bits = low > np.median(low)
    elif method == "dhash":
        small = resize(g, 8, 9, "lanczos").astype(np.int64)
        bits = small[:, 1:] > small[:, :-1]
    elif method == "ahash":
        small = resize(g, 8, 8, "lanczos").astype(np.float64)
        bits = small > small.mean()
    elif method == "whash":
        side = max(8, 1 << (min(g.shape).bit_length() - 1))
        fine = resize(g, side, side, "lanczos").astype(np.float64) / 255
        low = fine.reshape(8, side // 8, 8, side // 8).mean(axis=(1, 3))
        low = haar_low(low[None])[0]
        bits = low > np.median(low)
    else:
        raise ValueError(f"no hash method: {method}")
    return int(pack_bits(bits.reshape(1, -1))[0])


# Histograms, structure --------------------------------------------------------------------------------------------


def colour_histogram(bgr: np.ndarray) -> np.ndarray:
    """8x8x8 bins over the channels of the picture at 256x256, scaled to length 1."""
    small = resize(bgr, 256, 256).astype(np.int64) >> 5
    bins = np.bincount(((small[..., 0] * 8 + small[..., 1]) * 8 + small[..., 2]).ravel(), minlength=512).astype(np.float64)
    norm = np.linalg.norm(bins)
    return bins / norm if norm else bins


def correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation of all rows of a with all of b, 0 where negative, 1 where a variance is 0."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    scale = np.multiply.outer((a * a).sum(axis=1), (b * b).sum(axis=1))
    r = (a @ b.T) / np.sqrt(np.where(scale > 0, scale, 1.0))
    return np.maximum(0.0, np.where(np.abs(scale) > 2.2e-16, r, 1.0))


def _window_means(x: np.ndarray, window: int) -> np.ndarray:
    """Means over all whole windows of pictures (n, height, width, channels)."""
    s = np.pad(x.cumsum(axis=1).cumsum(axis=2), ((0, 0), (1, 0), (1, 0), (0, 0)))
    return (s[:, window:, window:] - s[:, :-window, window:] - s[:, window:, :-window] + s[:, :-window, :-window]) / window**2


def ssim_scores(a: np.ndarray, b: np.ndarray, window: int = 7) -> np.ndarray:
    """Mean structural similarity of all pictures of a with all of b, (n, height, width, channels) each.

    Uniform window, K1 0.01, K2 0.03, range 255, sample covariance; the mean is over the channels too. What one side
    needs of itself is worked out once a picture, what two share for one picture of a and all of b at a time.
    """
    x, y = a.astype(np.float64), b.astype(np.float64)
    n = window**2
    ux, uy = _window_means(x, window), _window_means(y, window)
    vx, vy = (n / (n - 1) * (_window_means(v * v, window) - u * u) for v, u in ((x, ux), (y, uy)))
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    out = np.empty((len(x), len(y)))
    for i in range(len(x)):
        both = ux[i] * uy
        covariance = n / (n - 1) * (_window_means(x[i] * y, window) - both)
        similar = (2 * both + c1) * (2 * covariance + c2) / ((ux[i] ** 2 + uy**2 + c1) * (vx[i] + vy + c2))
        out[i] = similar.mean(axis=(1, 2, 3))
    return out


def ssim(a: np.ndarray, b: np.ndarray, window: int = 7) -> float:
    """Mean structural similarity of two pictures of one size, gray or with channels."""
    x, y = (v[None, ..., None] if v.ndim == 2 else v[None] for v in (a, b))
    return float(ssim_scores(x, y, window)[0, 0])


# Key points -------------------------------------------------------------------------------------------------------


def _circle() -> list[tuple[int, int]]:
    """16 pixels around a centre at distance 3, in order."""
    quarter = [(-3, 0), (-3, 1), (-2, 2), (-1, 3)]
    out = []
    for _ in range(4):
        out += quarter
        quarter = [(x, -y) for y, x in quarter]
    return out


def key_points(g: np.ndarray, most: int = 300, contrast: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Corner positions (y, x) and 256-bit steered binary descriptors as four 64-bit words each.

    A corner has 9 of its 16 circle pixels in a row brighter or darker by the contrast; the strongest by the Harris
    measure are described by comparing pixel pairs of a smoothed patch, turned by the patch's intensity centroid.
    """
    x = g.astype(np.int64)
    h, w = x.shape
    edge = 20
    if min(h, w) <= 2 * edge:
        return np.empty((0, 2), np.int64), np.empty((0, 4), np.uint64)
    around = np.stack([np.roll(x, (-dy, -dx), (0, 1)) for dy, dx in _circle()])
    found = np.zeros((h, w), bool)
    for sign in (around > x + contrast, around < x - contrast):
        run = np.zeros((h, w), np.int64)
        best = np.zeros((h, w), np.int64)
        for k in range(24):
            run = np.where(sign[k % 16], run + 1, 0)
            best = np.maximum(best, run)
        found |= best >= 9
    found[:edge] = found[-edge:] = False
    found[:, :edge] = found[:, -edge:] = False
    gy, gx = np.gradient(x.astype(np.float64))

    def blur(v: np.ndarray, r: int) -> np.ndarray:
        p = np.pad(v, r, mode="edge")
        s = np.pad(p.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        k = 2 * r + 1
        return (s[k:, k:] - s[:-k, k:] - s[k:, :-k] + s[:-k, :-k]) / k**2

    a, b, c = blur(gx * gx, 3), blur(gx * gy, 3), blur(gy * gy, 3)
    strength = np.where(found, a * c - b * b - 0.04 * (a + c) ** 2, -np.inf)
    order = np.argsort(-strength, axis=None, kind="stable")[:most]
    order = order[np.isfinite(strength.ravel()[order])]
    at = np.stack(np.unravel_index(order, strength.shape), axis=1)
    if not len(at):
        return at, np.empty((0, 4), np.uint64)
    smooth = blur(x.astype(np.float64), 2)
    off = np.arange(-15, 16)
    dy, dx = np.meshgrid(off, off, indexing="ij")
    disk = dy**2 + dx**2 <= 225
    patches = x[at[:, 0, None] + dy[disk], at[:, 1, None] + dx[disk]]
    angle = np.arctan2((patches * dy[disk]).sum(axis=1), (patches * dx[disk]).sum(axis=1))
    pattern = np.clip(np.random.default_rng(256).normal(0, 31 / 5, (256, 2, 2)), -13, 13)
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    py = np.rint(at[:, 0, None, None] + pattern[None, ..., 0] * cos + pattern[None, ..., 1] * sin).astype(int)
    px = np.rint(at[:, 1, None, None] + pattern[None, ..., 1] * cos - pattern[None, ..., 0] * sin).astype(int)
    values = smooth[py, px]
    bits = values[..., 0] < values[..., 1]
    words = np.stack([pack_bits(bits[:, i : i + 64]) for i in range(0, 256, 64)], axis=1).astype(np.uint64)
    return at, words


def mutual_match_ratio(a: np.ndarray, b: np.ndarray, below: int = 50) -> float:
    """Share of mutual nearest descriptors closer than ``below`` bits, of the smaller count; ties go to the first."""
    if not len(a) or not len(b):
        return 0.0
    distance = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    ab, ba = distance.argmin(axis=1), distance.argmin(axis=0)
    mutual = ba[ab] == np.arange(len(a))
    return float((distance[np.arange(len(a)), ab][mutual] < below).sum() / min(len(a), len(b)))


# Vectors ----------------------------------------------------------------------------------------------------------


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm == 0, 1.0, norm)


def cosine_score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of all rows with all rows, moved from -1..1 to 0..1."""
    return (np.clip(unit(a) @ unit(b).T, -1.0, 1.0) + 1) / 2


def hamming_score(a: np.ndarray, b: np.ndarray, bits: int = 64) -> np.ndarray:
    return 1 - np.bitwise_count(a[:, None].astype(np.uint64) ^ b[None, :].astype(np.uint64)) / bits


def mean_max(similar: np.ndarray) -> float:
    """For each row the best column, averaged; 0 where either side is empty."""
    return float(similar.max(axis=1).mean()) if similar.size else 0.0
