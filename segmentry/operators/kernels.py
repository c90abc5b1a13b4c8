"""Numpy kernels that run inside tasks: block distances, smallest values, small networks, frame changes."""

from __future__ import annotations

import numpy as np


def block_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """L2 distances between the rows of a and of b, differences taken before squaring so that equal rows are at 0 exactly."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 22) // max(1, b.size))
    for at in range(0, len(a), step):
        out[at : at + step] = np.sqrt(((a[at : at + step, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    return out


#: Rows of b whose least bound stands for all of them, numbers of a block of bounds, and pairs whose distances are taken at once.
GROUP, BOUNDS, PAIRS = 128, 1 << 23, 1 << 16


def nearest(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places in b) of the k rows of b nearest to each row of a, or of all if there are fewer, in order; ties to the first place. Distances are those of block_distances.

    One matrix product in single precision gives |b|^2 - 2ab around the mean of b, within an error that is bounded. The k-th least of the groups' least bounds the k-th distance, and
    only pairs within twice the error of it have their distances taken. Rows that are not finite, or too large for squares in single precision, are compared one by one.
    """
    k = min(k, len(b))
    found = np.empty((len(a), k)), np.empty((len(a), k), dtype=np.int64)
    usable = k and len(a) and len(b) > GROUP * k
    if usable:
        with np.errstate(invalid="ignore", over="ignore"):
            centre = b.mean(axis=0)
            x, y = (a - centre).astype(np.float32), (b - centre).astype(np.float32)
            norms = [np.einsum("ij,ij->i", v, v, dtype=np.float64) for v in (x, y)]
        usable = all(np.isfinite(n).all() and n.max() < 1e30 for n in norms)
    step = max(1, BOUNDS // max(1, len(b)))
    if not usable:
        for at in range(0, len(a), step):
            d = block_distances(a[at : at + step], b)
            few = np.argsort(d, axis=1, kind="stable")[:, :k]
            found[0][at : at + step], found[1][at : at + step] = np.take_along_axis(d, few, axis=1), few
        return found
    groups = -(-len(b) // GROUP)
    held = np.zeros((x.shape[1] + 1, groups * GROUP), dtype=np.float32)
    held[:-1, : len(b)], held[-1] = y.T, np.finfo(np.float32).max
    held[-1, : len(b)] = norms[1]
    # Of the product and its rounded terms, of the shift by the centre, of distances that are equal only as roots, and of underflow.
    reach = np.sqrt(norms[0]) + np.sqrt(norms[1].max())
    shift = 2.0**-51 * (reach + np.abs(centre).max(initial=0.0) * x.shape[1] ** 0.5)
    error = (x.shape[1] + 16) * 2.0**-23 * reach**2 + 4 * shift * (reach + shift) + x.shape[1] * 1e-37
    for at in range(0, len(a), step):
        rows = x[at : at + step]
        bounds = np.hstack([-2 * rows, np.ones((len(rows), 1), np.float32)]) @ held
        bounds = bounds.reshape(len(rows), groups, GROUP)
        least = bounds.min(axis=2)
        limit = (np.partition(least, k - 1, axis=1)[:, k - 1] + 2 * error[at : at + step]).astype(np.float32)
        limit = np.nextafter(limit, np.float32(np.inf))
        row, group = np.nonzero(least <= limit[:, None])
        one, place = np.nonzero(bounds[row, group] <= limit[row][:, None])
        row, place = row[one], group[one] * GROUP + place
        row, place = row[place < len(b)], place[place < len(b)]
        d = np.empty(len(row))
        for i in range(0, len(row), PAIRS):
            d[i : i + PAIRS] = np.sqrt(((a[at + row[i : i + PAIRS]] - b[place[i : i + PAIRS]]) ** 2).sum(axis=1))
        order = np.lexsort((place, d, row))
        row, place, d = row[order], place[order], d[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        few = first[:, None] + np.arange(k)
        found[0][at : at + step], found[1][at : at + step] = d[few], place[few]
    return found


def smallest(x: np.ndarray, n: int) -> np.ndarray:
    """The n smallest values of each row, in order."""
    return np.sort(np.partition(x, n - 1, axis=1)[:, :n] if n < x.shape[1] else x, axis=1)


class Network:
    """Linear layers with leaky rectifiers between, and an end of tanh, sigmoid, rectifier or none. Weights are numpy arrays."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]], end: str = "tanh", slope: float = 0.01):
        self.layers, self.end, self.slope = layers, end, slope

    @classmethod
    def random(cls, sizes: list[int], seed: int, end: str = "tanh") -> Network:
        rng = np.random.default_rng(seed)
        return cls([(rng.normal(0, n**-0.5, (n, m)), np.zeros(m)) for n, m in zip(sizes, sizes[1:])], end)

    def _end(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.end == "tanh":
            y = np.tanh(z)
            return y, 1 - y * y
        if self.end == "sigmoid":
            y = 1 / (1 + np.exp(-z))
            return y, y * (1 - y)
        if self.end == "relu":
            return np.maximum(z, 0), (z > 0).astype(float)
        return z, np.ones_like(z)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        held = [x]
        for i, (w, b) in enumerate(self.layers):
            z = held[-1] @ w + b
            held.append(z if i + 1 == len(self.layers) else np.where(z > 0, z, self.slope * z))
        y, slope = self._end(held[-1])
        return y, held, slope

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0][:, 0]

    def backward(self, held: list[np.ndarray], slope: np.ndarray, out: np.ndarray) -> list[np.ndarray]:
        """Gradients of sum(out * y) by weights and biases, in the order of `flat`."""
        grads: list[np.ndarray] = []
        g = out[:, None] * slope
        for i in range(len(self.layers) - 1, -1, -1):
            grads = [held[i].T @ g, g.sum(axis=0), *grads]
            if i:
                g = (g @ self.layers[i][0].T) * np.where(held[i] > 0, 1.0, self.slope)
        return grads

    def flat(self) -> list[np.ndarray]:
        return [p for layer in self.layers for p in layer]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resizing of (h, w, c), pixel centres aligned."""
    h, w = image.shape[:2]
    y, x = (np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1) for n, m in ((height, h), (width, w)))
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def crop_to_colour(image: np.ndarray, low: tuple[int, int, int], high: tuple[int, int, int], size: int) -> np.ndarray:
    """A square around the centre of the pixels whose colour is between low and high; the middle of the image if there are none."""
    mask = ((image >= np.array(low)) & (image <= np.array(high))).all(axis=2)
    y, x = np.nonzero(mask)
    centre = (int(y.mean()), int(x.mean())) if len(y) else (image.shape[0] // 2, image.shape[1] // 2)
    a, b = (int(np.clip(c - size // 2, 0, max(0, n - size))) for c, n in zip(centre, image.shape))
    return image[a : a + size, b : b + size]


FRAME_OPS = {
    "flip": lambda x: x[::-1],
    "crop": lambda x, a, b, c, d: x[a:b, c:d],
    "stride": lambda x, n: x[::n, ::n],
    "resize": resize,
    "left": lambda x: x[:, : x.shape[1] // 2],
    "right": lambda x: x[:, x.shape[1] // 2 :],
    "reverse_channels": lambda x: x[:, :, ::-1],
    "crop_to_colour": crop_to_colour,
}


def apply_ops(image: np.ndarray, ops: list[tuple]) -> np.ndarray:
    for name, *args in ops:
        image = FRAME_OPS[name](image, *args)
    return np.ascontiguousarray(image)
