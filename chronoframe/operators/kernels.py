"""Pixel kernels: RGB frames as height x width x 3 numpy bytes, whole-array arithmetic, applied in Arrow batches.

Every kernel is a gather by index maps, a table or an integer formula over the whole picture; maps depend on the size alone and
are kept per worker. Divisions of numbers that may be negative cut towards zero.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Frame = np.ndarray
LUMA = np.array([77, 150, 29])
UNIT = 65536


def cut(a: np.ndarray, b) -> np.ndarray:
    """Integer division towards zero."""
    return np.sign(a) * (np.abs(a) // b)


def rounded(x):
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def to_bytes(x: np.ndarray) -> Frame:
    return np.clip(x, 0, 255).astype(np.uint8)


def grey(f: Frame) -> np.ndarray:
    return (f.astype(np.int32) @ LUMA) >> 8


def edge_mirror(c: np.ndarray, size: int) -> np.ndarray:
    """Reflected once with the edge repeated, then clamped."""
    a = np.abs(c)
    return np.clip(np.where(a >= size, 2 * size - 1 - a, a), 0, size - 1)


def periodic_mirror(c: np.ndarray, size: int) -> np.ndarray:
    if size <= 1:
        return np.zeros_like(c)
    last = size - 1
    p = np.mod(c, 2 * last)
    return np.where(p > last, 2 * last - p, p)


def gathered(f: Frame, xs: np.ndarray, ys: np.ndarray) -> Frame:
    """Pixels at any coordinates, the picture mirrored beyond its edges."""
    h, w, _ = f.shape
    return f[edge_mirror(ys, h), edge_mirror(xs, w)]


@lru_cache(maxsize=16)
def grid(h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[0:h, 0:w]
    return x.astype(np.int64), y.astype(np.int64)


def shares(n: int) -> np.ndarray:
    """Each coordinate as a share of UNIT."""
    return np.full(n, UNIT // 2) if n <= 1 else np.arange(n) * UNIT // (n - 1)


def blend_frames(frames: list[Frame]) -> Frame:
    """The integer mean; nothing rounds up."""
    return (sum(f.astype(np.uint32) for f in frames) // len(frames)).astype(np.uint8)


# One-frame effects.


def flash_white(f: Frame) -> Frame:
    return to_bytes((f.astype(np.int32) * 2 + 2040) // 10)


def flash_black(f: Frame) -> Frame:
    return to_bytes(f.astype(np.int32) * 2 // 10)


def invert(f: Frame) -> Frame:
    return np.repeat(to_bytes(255 - grey(f))[..., None], 3, axis=2)


def soft_tint_flash(f: Frame) -> Frame:
    return to_bytes((f.astype(np.int32) * [135, 120, 105] + [4000, 2000, 500]) // 100)


def directional_minimax(f: Frame, reach: int = 12) -> Frame:
    h = len(f)
    rows = np.clip(np.arange(h)[:, None] + np.arange(-reach, reach + 1), 0, h - 1)
    high = f[rows[:, 0]]
    for k in range(1, rows.shape[1]):
        high = np.maximum(high, f[rows[:, k]])
    return to_bytes((f.astype(np.int32) * 4 + high.astype(np.int32) * 6) // 10)


def warp_fisheye(f: Frame) -> Frame:
    h, w, _ = f.shape
    x, y = grid(h, w)
    cx, cy = w * 0.5, h * 0.5
    dx, dy = x - cx, y - cy
    factor = 1.0 + 0.45 * ((dx * dx + dy * dy) / (cx * cx + cy * cy))
    return gathered(f, rounded(cx + dx * factor).astype(np.int64), rounded(cy + dy * factor).astype(np.int64))


#: The octagon's corners and centre.
OCTAGON = [(0, -14), (10, -10), (14, 0), (10, 10), (0, 14), (-10, 10), (-14, 0), (-10, -10), (0, 0)]


def bokeh_octagon(f: Frame) -> Frame:
    h, w, _ = f.shape
    x, y = grid(h, w)
    total = np.zeros(f.shape, dtype=np.int64)
    for ox, oy in OCTAGON:
        p = gathered(f, x + ox, y + oy)
        total += p.astype(np.int64) * np.where(grey(p) > 140, 3, 1)[..., None]
    return to_bytes(total // 13 * 11 // 10)


def tint_scene(f: Frame) -> Frame:
    h, w, _ = f.shape
    dx, dy = np.meshgrid(np.arange(-2, 3), np.arange(-2, 3))
    mean = gathered(f, w // 2 + dx, h // 2 + dy).reshape(-1, 3).sum(axis=0, dtype=np.int64) // 25
    return to_bytes((f.astype(np.int64) * 4 + mean * 6) // 10)


def offset_blur(f: Frame) -> Frame:
    """The mean of the 31 pixels from 15 to 45 to the right, by prefix sums of the mirrored row."""
    _, w, _ = f.shape
    columns = edge_mirror(np.arange(15, w + 45 + 1), w)
    sums = np.concatenate([np.zeros((len(f), 1, 3), dtype=np.int64), np.cumsum(f[:, columns], axis=1, dtype=np.int64)], axis=1)
    return ((sums[:, 31 : 31 + w] - sums[:, :w]) // 31).astype(np.uint8)


def radial_blur(f: Frame, taps: int = 10) -> Frame:
    h, w, _ = f.shape
    x, y = grid(h, w)
    dx, dy = cut((x - w // 2) * UNIT, 25), cut((y - h // 2) * UNIT, 25)
    total = np.zeros(f.shape, dtype=np.int64)
    for k in range(taps):
        total += gathered(f, (x * UNIT + UNIT // 2 - k * dx) >> 16, (y * UNIT + UNIT // 2 - k * dy) >> 16)
    return (total // taps).astype(np.uint8)


ONE_FRAME: dict[str, Callable[[Frame], Frame]] = {
    "OFFSET_BLUR": offset_blur, "RADIAL_BLUR": radial_blur, "DIRECTIONAL_MINIMAX": directional_minimax, "WARP_FISHEYE": warp_fisheye, "BOKEH_OCTAGON": bokeh_octagon,
    "TINT_SCENE": tint_scene, "SOFT_TINT_FLASH": soft_tint_flash, "FLASH_WHITE": flash_white, "FLASH_BLACK": flash_black, "INVERT": invert,
}


def one_framer(f: Frame, name: str) -> Frame:
    """By name; an unknown name leaves the frame as it is."""
    return ONE_FRAME.get(name, np.copy)(f)


# Transitions.


def warp_bubble(f: Frame, amount: float, frequency: float) -> Frame:
    if amount <= 1e-6:
        return f.copy()
    h, w, _ = f.shape
    x, y = grid(h, w)
    rx, ry = w / 2.0, h / 2.0
    r = np.arange(2048, dtype=np.float64)
    scale = np.zeros(2048, dtype=np.float32)
    scale[1:] = amount * np.sin(frequency * (r[1:] / rx) * math.pi) * rx / r[1:]
    dx, dy = (x - int(rx)).astype(np.float32), (y - int(ry)).astype(np.float32)
    s = scale[np.minimum(np.sqrt(dx * dx + dy * dy).astype(np.int64), 2047)]
    return gathered(f, x - np.trunc(dx * s).astype(np.int64), y - np.trunc(dy * s).astype(np.int64))


def wave_warp(f: Frame, height: float, k: float, speed: float, frames: float) -> Frame:
    if abs(height) <= 1e-4:
        return f.copy()
    h, w, _ = f.shape
    shift = rounded(height * np.sin(np.arange(h) * k + frames * speed)).astype(np.int64)
    return f[np.arange(h)[:, None], edge_mirror(np.arange(w) - shift[:, None], w)]


def slide_shake(f: Frame, shift: float) -> Frame:
    if abs(shift) <= 1e-4:
        return f.copy()
    w = f.shape[1]
    return f[:, edge_mirror(np.arange(w) - int(rounded(shift)), w)]


# Ambiance.


def vignette_table(h: int, w: int, strength: float) -> np.ndarray:
    x, y = grid(h, w)
    rx, ry = w / 2.0, h / 2.0
    r = np.sqrt((x - rx) ** 2 + (y - ry) ** 2) / math.sqrt(rx * rx + ry * ry)
    return np.floor(np.clip(1.0 - strength * r**2, 0.0, 1.0) * 255.0).astype(np.int64)


def ambiance(f: Frame, exposure: float, tint: tuple[int, int, int], inverted: bool, vignette: float, scanlines: float, echo: list[Frame] = (), alpha: float = 0.0) -> Frame:
    """Exposure, echo of earlier frames (newest first; grey 128 where there is none yet), inversion, tint, then vignette and every fourth line dimmed."""
    h, w, _ = f.shape
    scale = int(min(max(1.0 + min(max(exposure, -0.999), 0.999), 0.0), 2.0) * 256.0)
    x = np.minimum((f.astype(np.int64) * scale) >> 8, 255)
    if len(echo):
        a = int(alpha * 256.0)
        x = ((256 - a) * x + a * (sum(e.astype(np.int64) for e in echo) // len(echo))) >> 8
    if inverted:
        x = np.repeat((255 - np.minimum((x @ LUMA) >> 8, 255))[..., None], 3, axis=2)
    x = np.clip(x + np.array(tint), 0, 255)
    shade = vignette_table(h, w, vignette)
    shade[::4] = (shade[::4] * int((1.0 - scanlines) * 256.0)) >> 8
    return ((x * shade[..., None]) >> 8).astype(np.uint8)


def box_blur(a: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """The integer mean over what of the window lies in the picture, by prefix sums."""
    a = np.moveaxis(a, axis, 0)
    n = len(a)
    sums = np.concatenate([np.zeros((1, *a.shape[1:]), dtype=np.int64), np.cumsum(a, axis=0, dtype=np.int64)])
    low, high = np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius + 1, n)
    return np.moveaxis((sums[high] - sums[low]) // (high - low).reshape(-1, *[1] * (a.ndim - 1)), 0, axis)


def deep_dark(f: Frame, seed: int) -> Frame:
    """Crushed luma, a glow of the highlights and hashed grain."""
    h, w, _ = f.shape
    y = grey(f).astype(np.int64)
    dark = np.minimum(y * y * 72 // 25500 + y * 28 // 100, 255)
    light = np.where(y > 25, np.minimum((y - 25) * 255 // 230, 255), 0)
    radius = max(1, min(10, w // 4, h // 4))
    glow = box_blur(box_blur(light, radius, 1), radius, 0)
    with np.errstate(over="ignore"):
        start = np.uint64(seed % (1 << 64)) * np.uint64(0x9E3779B97F4A7C15)
        grain = ((start + np.arange(h * w, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) % np.uint64(49)).astype(np.int64).reshape(h, w) - 24
    return np.repeat(to_bytes(dark + glow * 6 // 10 + grain)[..., None], 3, axis=2)


# Geometry.


def transform(f: Frame, dx=0.0, dy=0.0, scale=1.0, tilt=0.0, skew=0.0, scale_x=1.0, scale_y=1.0, barrel=0.0) -> Frame:
    """Inverse mapping in 16.16 fixed point, skew and barrel last, mirrored beyond the edges."""
    if max(abs(dx), abs(dy), abs(scale - 1.0), abs(tilt)) < 1e-4 and max(abs(skew), abs(scale_y - 1.0), abs(scale_x - 1.0), abs(barrel)) <= 1e-5:
        return f.copy()
    h, w, _ = f.shape
    cx, cy, s = w / 2.0, h / 2.0, 1.0 / scale
    sx, sy = (1.0 / v if abs(v) > 1e-5 else 1.0 for v in (scale_x, scale_y))
    cos, sin = math.cos(tilt), math.sin(tilt)
    yr = np.arange(h) - cy
    xs = np.trunc((cx - dx + skew * yr + s * (-cx * cos + yr * sy * sin)) * 65536.0 + 32768.0).astype(np.int64)[:, None] + np.arange(w) * int(rounded(s * cos * sx * 65536.0))
    ys = np.trunc((cy - dy + s * (cx * sin * sx + yr * sy * cos)) * 65536.0 + 32768.0).astype(np.int64)[:, None] + np.arange(w) * int(rounded(-s * sin * sx * 65536.0))
    if abs(barrel) > 1e-5:
        xf, yf = xs / 65536.0 - cx, ys / 65536.0 - cy
        factor = 1.0 + barrel * ((xf * xf + yf * yf) / max(cx * cx + cy * cy, 1.0))
        return gathered(f, np.trunc(cx + xf * factor).astype(np.int64), np.trunc(cy + yf * factor).astype(np.int64))
    return gathered(f, xs >> 16, ys >> 16)


def bilinear(f: Frame, x: float, y: float) -> np.ndarray:
    x0, y0 = math.floor(x), math.floor(y)
    wx, wy = x - x0, y - y0
    p = gathered(f, np.array([[x0, x0 + 1]] * 2), np.array([[y0] * 2, [y0 + 1] * 2])).astype(np.float64)
    rows = p[:, 0] * (1.0 - wx) + p[:, 1] * wx
    return to_bytes(rounded(rows[0] * (1.0 - wy) + rows[1] * wy))


def dissolve(f: Frame, ghost: Frame, alpha: float) -> Frame:
    """A share of at most half of a later frame over this one."""
    alpha = min(max(alpha, 0.0), 0.5)
    a = int(alpha * 256.0) if alpha > 1e-4 else 0
    return ((f.astype(np.int64) * (256 - a) + ghost.astype(np.int64) * a) >> 8).astype(np.uint8)


# Creative accents.


def mix32(v) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.asarray(v, dtype=np.uint64) & np.uint64(0xFFFFFFFF)
        low = np.uint64(0xFFFFFFFF)
        v = (v ^ (v >> np.uint64(16))) * np.uint64(0x7FEB352D) & low
        v = (v ^ (v >> np.uint64(15))) * np.uint64(0x846CA68B) & low
        return v ^ (v >> np.uint64(16))


def _around(n: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(np.arange(n) - radius, 0), np.minimum(np.arange(n) + radius, n - 1)


def edges(f: Frame, radius: int) -> np.ndarray:
    """The greatest channel difference to the neighbours at a distance, clamped to the picture."""
    h, w, _ = f.shape
    (left, right), (top, bottom) = _around(w, radius), _around(h, radius)
    g = f.astype(np.int64)
    return np.max([np.abs(g - n).max(axis=2) for n in (g[:, left], g[:, right], g[top], g[bottom])], axis=0)


def time_slice(f: Frame, other: Frame, phase: float, seed: int, amount: int) -> Frame:
    """Moving panels that show another frame."""
    h, w, _ = f.shape
    x, y = grid(h, w)
    panels, axis, direction = 2 + seed % 3, (seed >> 3) % 3, 1 if seed & 64 == 0 else -1
    step_x, step_y = UNIT // max(w, 1), UNIT // max(h, 1)
    along = [x * step_x, y * step_y, (x * step_x + y * step_y) // 2][axis]
    position = along * panels + int(rounded(phase * 65536.0 * direction))
    shown = np.mod(position, UNIT) < amount * 145
    shift = min(min(w, h) * amount // 10240, 18) * np.where((position // UNIT) & 1 == 0, 1, -1)
    sx = x if axis == 1 else periodic_mirror(x + shift, w)
    sy = y if axis == 0 else periodic_mirror(y - shift, h)
    return np.where(shown[..., None], other[sy, sx], f)


def ink_pulse(f: Frame, seed: int, amount: int) -> Frame:
    """Edges inked, flat parts posterised and printed in dots."""
    h, w, _ = f.shape
    x, y = grid(h, w)
    radius, cell = min(max(min(w, h) // 240, 1), 5), min(max(min(w, h) // 130, 3), 9)
    step = 32 if seed & 1 == 0 else 24
    edge = edges(f, radius)
    texture = np.minimum(edge - 6, 128) * 2
    ink = np.clip(edge - 18, 0, 160) * amount // 256
    luma = (f.astype(np.int64) @ LUMA) // 256
    dx, dy = 2 * ((x + seed % cell) % cell) - cell + 1, 2 * ((y + (seed >> 8) % cell) % cell) - cell + 1
    dot = np.where(dx * dx + dy * dy < (255 - luma) * cell * cell // 384, cut(texture * amount, 2048), 0)
    g = f.astype(np.int64)
    poster = np.minimum((g + step // 2) // step * step, 255)
    printed = g + cut((poster - g) * cut(texture * amount, 1024)[..., None], 256)
    made = cut(printed * np.maximum(256 - ink - dot, 0)[..., None], 256)
    return np.where((edge > 6)[..., None], made & 0xFF, g).astype(np.uint8)


def prism_drift(f: Frame, seed: int, amount: int) -> Frame:
    """Red and blue drift apart along edges, green makes up for their luma."""
    h, w, _ = f.shape
    x, y = grid(h, w)
    down, direction = seed & 1 != 0, 1 if seed & 2 == 0 else -1
    most = min(max(min(w, h) // 36, 1), 18)
    weight = np.clip(edges(f, -(-most // 2)) - 10, 0, 112) * amount // 112
    shift = cut(most * amount * direction * (144 + cut((x if down else y) * 112, max(w if down else h, 1))), 256)
    g = f.astype(np.int64)

    def channel(by: np.ndarray, c: int) -> np.ndarray:
        position = (y if down else x) * 256 + by
        low, part = position // 256, np.mod(position, 256)
        size = h if down else w
        first, second = periodic_mirror(low, size), periodic_mirror(low + 1, size)
        a, b = (g[first, x, c], g[second, x, c]) if down else (g[y, first, c], g[y, second, c])
        return (a * (256 - part) + b * part + 128) // 256

    red = cut(np.clip(channel(shift, 0) - g[..., 0], -96, 96) * weight, 256)
    blue = cut(np.clip(channel(-shift, 2) - g[..., 2], -96, 96) * weight, 256)
    return to_bytes(g + np.stack([red, cut(-(77 * red + 29 * blue), 150), blue], axis=2))


def _mixed(f: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return np.clip(cut(f * (256 - weight) + target * weight + 128, 256), 0, 255)


def focus_pull(f: Frame, phase: float, seed: int, amount: int) -> Frame:
    """Blurred by the distance from a plane that moves."""
    h, w, _ = f.shape
    radius = min(max(min(w, h) // 70, 1), 18)
    diagonal = -(-radius // 2)
    progress = phase if seed & 8 == 0 else 1.0 - phase
    plane = int(rounded(18000.0 + progress * 29536.0))
    nx, ny = shares(w)[None, :], shares(h)[:, None]
    position = [nx + 0 * ny, ny + 0 * nx, (3 * nx + ny) // 4, (nx + 3 * ny) // 4][seed % 4]
    weight = np.minimum(np.maximum(np.abs(position - plane) - 5400, 0) * 256 // 10000, 256) * amount * 7 // 2048
    g = f.astype(np.int64)
    (left, right), (top, bottom) = _around(w, radius), _around(h, radius)
    (dl, dr), (dt, db) = _around(w, diagonal), _around(h, diagonal)
    total = 4 * g + 2 * (g[:, left] + g[:, right] + g[top] + g[bottom]) + g[dt][:, dl] + g[dt][:, dr] + g[db][:, dl] + g[db][:, dr]
    return np.where((weight > 0)[..., None], _mixed(g, (total + 8) // 16, weight[..., None]), g).astype(np.uint8)


def relief_light(f: Frame, phase: float, seed: int, amount: int) -> Frame:
    """Slopes of luma lit from one side: warm crests, cool recesses, a beam that crosses."""
    h, w, _ = f.shape
    radius = min(max(min(w, h) // 180, 3), 8)
    angle = (seed % 628) / 100.0 + (phase - 0.5) * 1.8
    light_x, light_y = int(rounded(math.cos(angle) * 256.0)), int(rounded(math.sin(angle) * 256.0))
    luma = (f.astype(np.int64) @ LUMA) // 256
    (left, right), (top, bottom) = _around(w, radius), _around(h, radius)
    facing = cut((luma[:, right] - luma[:, left]) * light_x + (luma[bottom] - luma[top]) * light_y, 512)
    nx = shares(w)
    beam = np.maximum(256 - np.abs((UNIT - nx if seed & 1 else nx) - int(rounded(phase * UNIT))) * 256 // 24000, 0)
    shade = np.clip(cut(np.clip(facing, -160, 160) * amount * (192 + beam)[None, :], 131072), -64, 64)[..., None]
    g = f.astype(np.int64)
    tint = np.where(shade > 0, np.array([100, 86, 65]), np.array([64, 83, 100]))
    change = cut(shade * tint * np.where(shade > 0, 255 - g, g), 25600)
    return np.where((facing != 0)[..., None], np.clip(g + change, 0, 255), g).astype(np.uint8)


def torn_noise(position: np.ndarray, frequency: int, seed: np.ndarray) -> np.ndarray:
    p = position * frequency
    cell, part = p // UNIT, np.mod(p, UNIT)
    at = lambda c: (mix32(seed ^ (c & 0xFFFFFFFF)) & np.uint64(511)).astype(np.int64) - 256
    first = at(cell)
    return first + cut((at(cell + 1) - first) * part, UNIT)


def paper_depth(position: np.ndarray, travel: int, seed: int, side: int, amount: int) -> np.ndarray:
    own = int(mix32(seed ^ (side * 0x9E3779B9 & 0xFFFFFFFF)))
    p = position + travel * (1 if side & 1 == 0 else -1)
    rough = cut(torn_noise(p, 28, own) * 390, 256) + cut(torn_noise(p, 117, own ^ 0xA341316C) * 170, 256) + cut(torn_noise(p, 431, own ^ 0xC8013EA4) * 75, 256)
    return np.clip(950 + own % 350 + rough, 200, 1700) * amount // 256


def paper_gate(f: Frame, phase: float, seed: int, amount: int) -> Frame:
    """A torn paper frame, its backing and its shadow."""
    h, w, _ = f.shape
    x, y = grid(h, w)
    travel, reach = int(rounded(phase * 3200.0)), 2300
    paper = np.array([228, 224, 211] if seed & 1 == 0 else [214, 222, 230])
    backing = np.array([46, 54, 69] if seed & 2 == 0 else [82, 54, 49])
    nx, ny = shares(w)[None, :], shares(h)[:, None]
    depth = lambda p, side: paper_depth(p, travel, seed, side, amount)
    gap = np.maximum(depth(ny, 0) - nx, depth(ny, 1) - (UNIT - nx))
    gap = np.where(ny <= reach, np.maximum(gap, depth(nx, 2) - ny), gap)
    gap = np.where(ny >= UNIT - reach, np.maximum(gap, depth(nx, 3) - (UNIT - ny)), gap)
    inner = (nx > reach) & (nx < UNIT - reach) & (ny > reach) & (ny < UNIT - reach)
    thick, soft = 140 * amount // 256, 600 * amount // 256
    g = f.astype(np.int64)
    grain = (mix32(seed ^ (x * 17 & 0xFFFFFFFF) ^ (y * 7919 & 0xFFFFFFFF)) % np.uint64(7)).astype(np.int64) - 3
    fibre = np.where(gap < 90 * amount // 256, 7, 0)
    sheet = _mixed(g, paper + (grain + fibre)[..., None], np.int64(amount))
    under = _mixed(g, backing, np.int64(amount * 3 // 4))
    shadow = cut(cut((soft + gap) * amount, max(soft, 1)), 3)
    dim = g * (256 - shadow)[..., None] // 256
    out = np.where((gap >= 0)[..., None], sheet, np.where((gap >= -thick)[..., None], under, dim & 0xFF))
    return np.where((inner | (gap < -soft))[..., None], g, out).astype(np.uint8)


def creative(f: Frame, kind: str, phase: float, seed: int, strength: float, other: Frame | None = None) -> Frame:
    """By kind; the frame itself outside its phase or without strength."""
    if f.size == 0 or not (math.isfinite(phase) and 0.0 < phase < 1.0 and math.isfinite(strength) and strength > 0.0):
        return f.copy()
    amount = int(rounded(math.sin(math.pi * phase) ** 2 * min(strength, 1.0) * 256.0))
    if amount == 0:
        return f.copy()
    mixed = int(mix32(seed))
    if kind == "time_slice":
        return f.copy() if other is None else time_slice(f, other, phase, mixed, amount)
    if kind in ("ink_pulse", "prism_drift"):
        return {"ink_pulse": ink_pulse, "prism_drift": prism_drift}[kind](f, mixed, amount)
    return {"focus_pull": focus_pull, "relief_light": relief_light, "paper_gate": paper_gate}[kind](f, phase, mixed, amount)


# Analysis.


def motion_score(before: np.ndarray, now: np.ndarray) -> tuple[float, float]:
    """Activity and confidence between two luma pictures: blocks of 6 x 6 every 8 pixels, moved by up to 3, exposure taken out.

    All blocks and all 49 moves are one array each; pictures under 12 x 12 score nothing.
    """
    h, w = now.shape
    if w < 12 or h < 12 or before.shape != now.shape:
        return 0.0, 0.0
    before, now = before.astype(np.float32), now.astype(np.float32)
    exposure = now.mean(dtype=np.float32) - before.mean(dtype=np.float32)
    by, bx = np.meshgrid(np.arange(3, h - 8, 8), np.arange(3, w - 8, 8), indexing="ij")
    dy, dx = np.meshgrid(np.arange(0, 6, 2), np.arange(0, 6, 2), indexing="ij")
    ys, xs = by.reshape(-1, 1) + dy.reshape(1, -1), bx.reshape(-1, 1) + dx.reshape(1, -1)
    textured = np.abs(before[ys, xs] - before[ys, xs + 1]).sum(axis=1) >= 12.0
    ys, xs = ys[textured], xs[textured]
    if not len(ys):
        return 0.0, 0.0
    here = now[ys, xs] - exposure
    error = lambda sx, sy: np.abs(here - before[ys + sy, xs + sx]).sum(axis=1) / np.float32(9.0)
    base = error(0, 0)
    best, distance = base.copy(), np.zeros(len(ys))
    for sy in range(-3, 4):
        for sx in range(-3, 4):
            cost = error(sx, sy)
            better = cost + np.float32(0.5) < best
            best[better], distance[better] = cost[better], math.hypot(sx, sy)
    with np.errstate(divide="ignore", invalid="ignore"):
        sure = np.clip((base - best) / base, 0.0, 1.0).astype(np.float64)
    hit = (base >= 2.0) & (sure > 0.2) & (best < 24.0)
    activity = (np.minimum(distance / 3.0, 1.0) * sure)[hit].sum()
    return float(min(max(activity / len(ys), 0.0), 1.0)), float(min(max(sure[hit].sum() / len(ys), 0.0), 1.0))


def is_blank(planes: list[np.ndarray], black: int, white: int, mid: int | None = None) -> bool:
    """Whether all samples of the first plane are black or all are white, and all others at the middle."""
    first = planes[0]
    return bool(((first == black).all() or (first == white).all()) and all((p == mid).all() for p in planes[1:]))


def sample_places(h: int, w: int, most_w: int = 160, most_h: int = 90) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the centres that a picture is looked at by, at most most_w x most_h of them."""
    sw, sh = min(w, most_w), min(h, most_h)
    return (2 * np.arange(sh) + 1) * h // (2 * sh), (2 * np.arange(sw) + 1) * w // (2 * sw)


def homography(source: list[tuple[float, float]], target: list[tuple[float, float]]) -> np.ndarray:
    """The eight numbers that take target corners to source corners, by least squares."""
    rows, right = [], []
    for (x, y), (u, v) in zip(target, source, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return np.linalg.lstsq(np.array(rows, dtype=float), np.array(right, dtype=float), rcond=None)[0]


def over_frames(frames: DataFrame, kernel: Callable[[Frame, dict], Frame], params: list[str], pixels: str = "pixels") -> DataFrame:
    """frames (height, width, pixels as RGB bytes, params...) with each frame's pixels replaced by the kernel's."""
    schema = frames.schema
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select([pixels, "height", "width", *params]).to_pylist()
            out = [kernel(np.frombuffer(r[pixels], dtype=np.uint8).reshape(r["height"], r["width"], 3), r).tobytes() for r in rows]
            at = names.index(pixels)
            yield batch.set_column(at, pixels, pa.array(out, pa.binary()))

    return frames.mapInArrow(run, schema)
