"""Image forensics: what a 32 x 32 block of a scan says about later edits.

JPEG quality is read from a file's own tables, without decoding. Block features need decoded pixels and a JPEG codec:
they take arrays and a codec function, so any image library serves; without one, decode() says so.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable

import numpy as np

BLOCK, INK, QUALITIES, LEAST_QUALITY = 32, 12.0, (75, 90, 95), 85
#: The standard luminance quantisation table of JPEG (ITU T.81, annex K), row by row.
LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)


def luma_table(data: bytes) -> list[int] | None:
    """The values of the lowest-numbered quantisation table of a JPEG file; None if the bytes are no JPEG or have none."""
    if data[:2] != b"\xff\xd8":
        return None
    tables, at = {}, 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        if data[at + 1] == 0xFF:  # padding
            at += 1
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        part = data[at + 4 : at + 2 + size]
        while data[at + 1] == 0xDB and part:
            wide = part[0] >> 4
            length = 128 if wide else 64
            raw = part[1 : 1 + length]
            if len(raw) == length:
                tables[part[0] & 15] = list(struct.unpack(">64H", raw)) if wide else list(raw)
            part = part[1 + length :]
        at += 2 + size
    return tables[min(tables)] if tables else None


def jpeg_quality(data: bytes) -> int | None:
    """The quality from 1 to 100 whose scaled standard table is nearest to the file's, both sorted; the lowest of equals."""
    found = luma_table(data)
    if found is None:
        return None
    base, own = np.array(LUMA, np.int64), np.sort(np.array(found))
    scale = lambda q: 5000 / q if q < 50 else 200 - 2 * q
    off = [int(np.abs(np.sort(np.clip((base * scale(q) + 50) // 100, 1, 255)) - own).sum()) for q in range(1, 101)]
    return 1 + off.index(min(off))


def cannot_assess(data: bytes) -> str | None:
    """Why a file cannot be judged, or None."""
    q = jpeg_quality(data)
    if q is not None and q < LEAST_QUALITY:
        return f"not checked: the image is a JPEG saved at quality {q}, and compression that strong erases the traces of edits. Upload the original scan or a PNG"
    return None


def decode(data: bytes):
    """(grey pixels, codec) of an image file; the codec saves at a quality and gives the grey pixels read back."""
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("reading images needs the Pillow library, which is not installed") from e
    image = Image.open(io.BytesIO(data)).convert("RGB")

    def codec(quality: int) -> np.ndarray:
        out = io.BytesIO()
        image.save(out, "JPEG", quality=quality)
        return np.asarray(Image.open(out).convert("L"), np.float32)

    return np.asarray(image.convert("L"), np.float32), codec


def _windows(a: np.ndarray) -> np.ndarray:
    """The 3 x 3 surroundings of each place, edges repeated."""
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, 1, mode="edge"), (3, 3))


def _blocks(a: np.ndarray) -> np.ndarray:
    h, w = (n // BLOCK for n in a.shape)
    return a[: h * BLOCK, : w * BLOCK].reshape(h, BLOCK, w, BLOCK).transpose(0, 2, 1, 3).reshape(h, w, -1)


def block_features(grey: np.ndarray, codec: Callable[[int], np.ndarray]) -> list[dict[str, float]]:
    """A row for each block with ink: 17 statistics of grey levels, compression errors, noise and edges, each as it is,
    relative to the image's inked median, and minus the mean of its 8 neighbours; bx, by and ink_share."""
    if min(grey.shape) < BLOCK:
        return []
    grey = grey.astype(np.float32)
    around = _windows(grey)
    maps = {f"ela{q}": np.abs(grey - codec(q)) for q in QUALITIES}
    maps["noise"] = grey - np.median(around, axis=(2, 3))
    edge = np.clip(9 * grey - around.sum((2, 3)), 0, 255)
    edge[[0, -1], :], edge[:, [0, -1]] = grey[[0, -1], :], grey[:, [0, -1]]
    maps["edge"] = edge
    cells = _blocks(grey)
    stats = {"gray_std": cells.std(2), "gray_mean": cells.mean(2)}
    for name, m in maps.items():
        b = _blocks(m)
        stats |= {f"{name}_mean": np.abs(b).mean(2), f"{name}_std": b.std(2), f"{name}_max": np.abs(b).max(2)}
    ink = stats["gray_std"] > INK
    columns: dict[str, np.ndarray] = {}
    for name, v in stats.items():
        middle = float(np.median(v[ink])) if ink.any() else 1.0
        columns |= {name: v, f"{name}_rel": v / (middle + 1e-6), f"{name}_nb": v - (_windows(v).sum((2, 3)) - v) / 8}
    share = float(ink.mean())
    return [{k: float(c[y, x]) for k, c in columns.items()} | {"by": int(y), "bx": int(x), "ink_share": share} for y, x in zip(*np.nonzero(ink), strict=True)]
