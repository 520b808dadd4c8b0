"""Colours as Column expressions: sRGB to L*a*b* under D65, the CIEDE2000 difference, likeness of colour texts."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, functions as F

from .geometry import _let

# Linear sRGB to XYZ, the white of D65 (2 degrees), and the bound and slope of L*a*b* near black.
_XYZ = ((0.412424, 0.357579, 0.180464), (0.212656, 0.715158, 0.0721856), (0.0193324, 0.119193, 0.950444))
_WHITE = (0.95047, 1.0, 1.08883)
_DARK, _SLOPE = 216.0 / 24389.0, 7.787


def lab(hex_text: Column) -> Column:
    """struct<l, a, b> of a text #rrggbb (more digits are left out); null if it is none."""
    channel = lambda k: F.conv(F.substring(hex_text, 2 + 2 * k, 2), 16, 10).cast("double") / 255
    linear = lambda v: F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))
    bent = lambda v: F.when(v > _DARK, F.pow(v, F.lit(1 / 3))).otherwise(_SLOPE * v + 16 / 116)

    def told(rgb: Column) -> Column:
        return F.array(*[bent(sum(F.get(rgb, F.lit(k)) * m for k, m in enumerate(row)) / white) for row, white in zip(_XYZ, _WHITE, strict=True)])

    def axes(f: Column) -> Column:
        x, y, z = (F.get(f, F.lit(k)) for k in range(3))
        return F.struct((116 * y - 16).alias("l"), (500 * (x - y)).alias("a"), (200 * (y - z)).alias("b"))

    rgb = F.array(*[linear(channel(k)) for k in range(3)])
    return F.when(hex_text.rlike("^#[0-9A-Fa-f]{6}"), _let(_let(rgb, told), axes))


def difference(p: Column, q: Column) -> Column:
    """CIEDE2000 of two struct<l, a, b>, all weights 1. A colour without chroma has the hue of the other one."""
    far = 25.0**7

    def staged(s: Column, **new: Column) -> Column:
        return F.struct(*[s[n].alias(n) for n in ("l1", "l2", "b1", "b2")], *[c.alias(n) for n, c in new.items()])

    def chroma(s: Column) -> Column:
        mean = (F.hypot(s["a1"], s["b1"]) + F.hypot(s["a2"], s["b2"])) / 2
        wide = 1.5 - 0.5 * F.sqrt(F.pow(mean, F.lit(7.0)) / (F.pow(mean, F.lit(7.0)) + far))
        return staged(s, a1=s["a1"] * wide, a2=s["a2"] * wide)

    def hues(s: Column) -> Column:
        hue = lambda a, b: F.when((a == 0) & (b == 0), 0.0).otherwise(F.pmod(F.atan2(b, a), F.lit(2 * math.pi)))
        return staged(s, c1=F.hypot(s["a1"], s["b1"]), c2=F.hypot(s["a2"], s["b2"]), h1=hue(s["a1"], s["b1"]), h2=hue(s["a2"], s["b2"]))

    def total(s: Column) -> Column:
        grey, turn = s["c1"] * s["c2"] == 0, s["h2"] - s["h1"]
        round_ = F.when(turn > math.pi, turn - 2 * math.pi).when(turn < -math.pi, turn + 2 * math.pi).otherwise(turn)
        both = s["h1"] + s["h2"]
        h = F.when(grey, both).when(F.abs(turn) <= math.pi, both / 2).when(both < 2 * math.pi, both / 2 + math.pi).otherwise(both / 2 - math.pi)
        parts = F.struct(
            ((s["l1"] + s["l2"]) / 2).alias("l"), ((s["c1"] + s["c2"]) / 2).alias("c"), h.alias("h"), (s["l2"] - s["l1"]).alias("dl"), (s["c2"] - s["c1"]).alias("dc"),
            F.when(grey, 0.0).otherwise(2 * F.sqrt(s["c1"] * s["c2"]) * F.sin(round_ / 2)).alias("dh"),
        )
        return _let(parts, weighed)

    def weighed(m: Column) -> Column:
        cos = lambda k, shift: F.cos(m["h"] * k + math.radians(shift))
        t = 1 - 0.17 * cos(1, -30) + 0.24 * cos(2, 0) + 0.32 * cos(3, 6) - 0.20 * cos(4, -63)
        light = (m["l"] - 50) * (m["l"] - 50)
        l, c, h = m["dl"] / (1 + 0.015 * light / F.sqrt(20 + light)), m["dc"] / (1 + 0.045 * m["c"]), m["dh"] / (1 + 0.015 * m["c"] * t)
        bend = (F.degrees(m["h"]) - 275) / 25
        r = -2 * F.sqrt(F.pow(m["c"], F.lit(7.0)) / (F.pow(m["c"], F.lit(7.0)) + far)) * F.sin(F.radians(60 * F.exp(-bend * bend)))
        return F.sqrt(l * l + c * c + h * h + r * c * h)

    first = lambda s: F.struct(*[s[side][axis].alias(axis + n) for axis in "lab" for side, n in (("p", "1"), ("q", "2"))])
    return _let(_let(_let(_let(F.struct(p.alias("p"), q.alias("q")), first), chroma), hues), total)


def likeness(a: Column, b: Column, lab_a: Column | None = None, lab_b: Column | None = None) -> Column:
    """Of two texts #rrggbb, 1 - difference / 100, at least 0; of two other texts, 1 if they are equal; 0 for one of each, for
    nulls and for what begins with # but is no colour. lab_a, lab_b: their ``lab``, where it is at hand."""
    coded = lambda c: c.startswith("#")
    own = [lab(c) if known is None else known for c, known in ((a, lab_a), (b, lab_b))]
    near = F.greatest(F.lit(0.0), 1 - difference(*own) / 100)
    return F.coalesce(F.when(coded(a) & coded(b), F.when(a == b, F.when(own[0].isNotNull(), 1.0)).otherwise(near)).when(~coded(a) & ~coded(b), (a == b).cast("double")), F.lit(0.0))


def labs(texts: Sequence[str]) -> np.ndarray:
    """``lab`` of many texts: three columns, nan where a text is no colour."""
    codes = [int(x[1:7], 16) if re.match("#[0-9A-Fa-f]{6}", x) else -1 for x in texts]
    n = np.array(codes, np.int64)
    v = np.stack([n >> 16, n >> 8 & 255, n & 255], axis=1) / 255
    xyz = np.where(v <= 0.04045, v / 12.92, ((v + 0.055) / 1.055) ** 2.4) @ np.array(_XYZ).T / np.array(_WHITE)
    x, y, z = np.where(xyz > _DARK, np.abs(xyz) ** (1 / 3), _SLOPE * xyz + 16 / 116).T
    out = np.stack([116 * y - 16, 500 * (x - y), 200 * (y - z)], axis=1)
    out[n < 0] = np.nan
    return out


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``difference`` of many pairs of ``labs``."""
    (l1, a1, b1), (l2, a2, b2) = p.T, q.T
    far = 25.0**7
    mean = ((np.hypot(a1, b1) + np.hypot(a2, b2)) / 2) ** 7
    wide = 1.5 - 0.5 * np.sqrt(mean / (mean + far))
    a1, a2 = a1 * wide, a2 * wide
    c1, c2 = np.hypot(a1, b1), np.hypot(a2, b2)
    h1, h2 = (np.where((a == 0) & (b == 0), 0.0, np.arctan2(b, a) % (2 * np.pi)) for a, b in ((a1, b1), (a2, b2)))
    grey, turn, both = c1 * c2 == 0, h2 - h1, h1 + h2
    around = np.where(turn > np.pi, turn - 2 * np.pi, np.where(turn < -np.pi, turn + 2 * np.pi, turn))
    h = np.where(grey, both, np.where(np.abs(turn) <= np.pi, both / 2, np.where(both < 2 * np.pi, both / 2 + np.pi, both / 2 - np.pi)))
    c, light = (c1 + c2) / 2, ((l1 + l2) / 2 - 50) ** 2
    dh = np.where(grey, 0.0, 2 * np.sqrt(c1 * c2) * np.sin(around / 2))
    t = 1 - 0.17 * np.cos(h - np.radians(30)) + 0.24 * np.cos(2 * h) + 0.32 * np.cos(3 * h + np.radians(6)) - 0.20 * np.cos(4 * h - np.radians(63))
    dl, dc, dh = (l2 - l1) / (1 + 0.015 * light / np.sqrt(20 + light)), (c2 - c1) / (1 + 0.045 * c), dh / (1 + 0.015 * c * t)
    bend = (np.degrees(h) - 275) / 25
    r = -2 * np.sqrt(c**7 / (c**7 + far)) * np.sin(np.radians(60 * np.exp(-bend * bend)))
    return np.sqrt(dl * dl + dc * dc + dh * dh + r * dc * dh)


def likenesses(a: np.ndarray, b: np.ndarray, lab: np.ndarray, coded: np.ndarray) -> np.ndarray:
    """``likeness`` of many pairs of texts, given by their places in ``lab`` and ``coded`` (whether a text begins with #)."""
    out = ((a == b) & ~coded[a] & ~coded[b]).astype(float)
    near = np.flatnonzero(coded[a] & coded[b])
    x, y = a[near], b[near]
    some = np.where(x == y, np.where(np.isnan(lab[x, 0]), 0.0, 1.0), np.fmax(0.0, 1 - differences(lab[x], lab[y]) / 100))
    out[near] = some
    return out


def unlike(own: np.ndarray, lab: np.ndarray, coded: np.ndarray, near: float = 0.7) -> np.ndarray:
    """Which of some texts (places, as for ``likenesses``) are not near one kept before; the first is kept."""
    kept: list[int] = []
    for at, x in enumerate(own):
        if not (likenesses(np.full(len(kept), x), own[kept], lab, coded) > near).any():
            kept.append(at)
    return np.array(kept, int)
