"""Settings of an artist to engine parameters: pure arithmetic on the driver, literals in plans."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Threads, fidelity, complexity, colour fidelity of each preset.
PRESETS = {"portrait": (18, 0.6, 0.5, 0.6), "animal": (16, 0.55, 0.55, 0.6), "botanical": (14, 0.6, 0.45, 0.65), "landscape": (20, 0.4, 0.4, 0.5), "flat": (8, 0.9, 0.6, 0.95)}
STITCH_WIDTH_MM = {1: 0.4, 2: 0.6, 3: 0.8, 6: 1.2}
LONG_EDGE_PX = (256, 1200)


@dataclass(frozen=True)
class Settings:
    preset: str = "custom"
    thread_count: int = 16
    fidelity: float = 0.5
    complexity: float = 0.5
    color_fidelity: float = 0.6
    min_detail_mm: float | None = None
    outline: float = 0.5
    width_mm: float = 150.0
    height_mm: float = 150.0
    strands: int = 1
    locked: tuple[str, ...] = ()
    hue: float = 0.0
    saturation: float = 0.0
    lightness: float = 0.0


@dataclass(frozen=True)
class Params:
    px_per_mm: float
    min_feature_mm: float
    min_area_mm2: float
    blur_mm: float
    mode_radius_mm: float
    contrast_weight: float
    lightness_weight: float
    merge_delta: float
    keep_delta: float
    max_regions: int
    simplify_mm: float
    smoothing: int
    corner_degrees: float
    ramp_weight: float
    halo: float
    line_max_mm: float
    line_min_mm: float
    speck_mm: float
    line_contrast: float


def lerp(a: float, b: float, t: float) -> float:
    return a + (b - a) * max(0.0, min(1.0, t))


def preset_settings(settings: Settings) -> Settings:
    """The preset's knobs; a custom one keeps its own."""
    if settings.preset not in PRESETS:
        return settings
    n, f, c, cf = PRESETS[settings.preset]
    return replace(settings, thread_count=n, fidelity=f, complexity=c, color_fidelity=cf)


def derive(s: Settings) -> Params:
    f, c, cf, flat = s.fidelity, s.complexity, s.color_fidelity, s.preset == "flat"
    feature = s.min_detail_mm if s.min_detail_mm is not None else 1.0 if flat else lerp(3.2, 0.8, c)
    simplify = lerp(0.55, 0.14, f)
    return Params(
        px_per_mm=4.0, min_feature_mm=feature, min_area_mm2=feature * feature,
        blur_mm=0.0 if flat else feature * lerp(0.5, 0.15, f), mode_radius_mm=0.0 if flat else feature / 2,
        contrast_weight=0.4 if flat else lerp(0.4, 2.5, f), lightness_weight=1.4,
        merge_delta=lerp(0.16, 0.05, cf) if flat else lerp(0.10, 0.012, cf), keep_delta=0.12 if flat else lerp(0.38, 0.2, f),
        max_regions=int(lerp(40, 400, c) + 0.5), simplify_mm=min(simplify, 0.2) if flat else simplify,
        smoothing=0 if flat else 2, corner_degrees=80.0, ramp_weight=0.35, halo=0.7,
        line_max_mm=2 * STITCH_WIDTH_MM[s.strands], line_min_mm=1.5, speck_mm=0.5, line_contrast=0.16 if flat else lerp(0.3, 0.16, f),
    )


def working_resolution(s: Settings, px_per_mm: float) -> tuple[int, int, float]:
    """(width, height, millimetres a pixel); the long edge stays in bounds."""
    longest = max(s.width_mm, s.height_mm)
    edge = max(LONG_EDGE_PX[0], min(LONG_EDGE_PX[1], round(longest * px_per_mm)))
    mm = longest / edge
    return max(1, int(s.width_mm / mm + 0.5)), max(1, int(s.height_mm / mm + 0.5)), mm


def cropped_size(width: int, height: int, rect: tuple[float, float, float, float], rotation: int) -> tuple[int, int]:
    w, h = max(1, int(width * rect[2] + 0.5)), max(1, int(height * rect[3] + 0.5))
    return (h, w) if rotation % 180 else (w, h)


def rotate_dims(width_mm: float, height_mm: float, rotation: int, by: int) -> tuple[float, float, int]:
    return (height_mm, width_mm, (rotation + by) % 360) if by % 180 else (width_mm, height_mm, (rotation + by) % 360)


def fabric_tolerance(t: float) -> float:
    return 0.015 + max(0.0, min(1.0, t)) * 0.2
