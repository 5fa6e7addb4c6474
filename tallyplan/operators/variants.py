"""Variants of a template's mask: sizes, mirror images and turns by any angle."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

# Turns and the scales that slanted turns are for, in percent.
QUARTERS = (0, 90, 180, 270)
SLANTED = (45, 75, 135, 195, 225, 285, 315)
SLANTED_LABELS = (45, 135, 225, 315)
SLANTED_FROM = 80
SLANTED_LABELS_TO = 110
#: Steps of a pixel that sampled places are rounded to, so that a turn by 360 degrees in parts doesn't depend on the last bit.
STEPS = 1024


class Variant(NamedTuple):
    template_id: int
    scale: int
    turn: int
    mirrored: bool
    mask: np.ndarray

    @property
    def key(self) -> tuple[int, int, int, bool]:
        return self.template_id, self.scale, self.turn, self.mirrored


def resized(mask: np.ndarray, percent: int) -> np.ndarray:
    """The mask at another size, each pixel the nearest one above and to the left."""
    h, w = (max(1, int(round(size * percent / 100))) for size in mask.shape)
    return mask[np.ix_(np.arange(h) * mask.shape[0] // h, np.arange(w) * mask.shape[1] // w)]


def frame(h: int, w: int, degrees: int) -> tuple[int, int]:
    """Height and width of what holds a turned h x w mask."""
    cos, sin = abs(np.cos(np.deg2rad(degrees))), abs(np.sin(np.deg2rad(degrees)))
    return max(1, int(round(w * sin + h * cos))), max(1, int(round(h * sin + w * cos)))


def sampled(h: int, w: int, degrees: int) -> tuple[np.ndarray, np.ndarray]:
    """For every pixel of the turned frame the row and column of the mask that it shows; some lie outside of it.

    The turn is about the middles of both: the frame's pixels are turned back and take the nearest pixel.
    """
    rows, columns = frame(h, w, degrees)
    cos, sin = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    y, x = np.mgrid[:rows, :columns]
    dy, dx = y - rows / 2, x - columns / 2
    nearest = lambda v: np.floor(np.floor(v * STEPS + 0.5) / STEPS + 0.5).astype(np.int64)
    return nearest(cos * dy - sin * dx + h / 2), nearest(cos * dx + sin * dy + w / 2)


def turned(mask: np.ndarray, degrees: int) -> np.ndarray:
    """The mask turned clockwise; quarters are exact, other turns sample it in a frame that grows with the angle."""
    if degrees % 90 == 0:
        return np.rot90(mask, -(degrees // 90))
    r, c = sampled(*mask.shape, degrees)
    inside = (r >= 0) & (r < mask.shape[0]) & (c >= 0) & (c < mask.shape[1])
    out = np.zeros(r.shape, dtype=bool)
    out[inside] = mask[r[inside], c[inside]]
    return out


def variants(template_id: int, mask: np.ndarray, scales: tuple[int, ...] = (90, 100, 110), mirror: bool = True, slanted: bool = False, label: bool = False) -> list[Variant]:
    """All variants with ink: each scale, mirrored or not, by quarters; from 80 % on also by slanted turns if the template asks
    for them, and labels by four of these from 80 to 110 %."""
    out = []
    for scale in scales:
        turns = QUARTERS
        if slanted and scale >= SLANTED_FROM:
            turns = QUARTERS + SLANTED
        elif label and SLANTED_FROM <= scale <= SLANTED_LABELS_TO:
            turns = QUARTERS + SLANTED_LABELS
        size = mask if scale == 100 else resized(mask, scale)
        for mirrored in (False, True) if mirror else (False,):
            for turn in turns:
                image = turned(size[:, ::-1] if mirrored else size, turn)
                if image.any():
                    out.append(Variant(template_id, scale, turn, mirrored, image.astype(bool)))
    return out
