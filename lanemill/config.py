"""Parameters with their effective defaults, and parameter files."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path


@dataclass(frozen=True)
class LaneConfig:
    """Lane map pipeline. Ties in trimming are judged with the two tolerances."""

    crop: bool = False
    crop_size: float = 300.0
    cell_size: float = 50.0
    lane_types: tuple[int, ...] = tuple(range(6, 14))
    max_segment: float = 10.0
    start_radius: float = 3.0
    overlap_radius: float = 0.3
    linearity_tie: float = 1e-3
    length_tie: float = 1.0
    search_radius: float = 1.5
    direction_threshold_deg: float = 30.0
    weight_distance: float = 1.0
    weight_direction: float = 5.0


@dataclass(frozen=True)
class BatchConfig:
    """Count-based sliding batches of frames."""

    size: int = 20
    overlap: int = 5
    max_misses: int = 5
    start_index: int = 20_000
    frame_limit: int = 10_000

    def __post_init__(self) -> None:
        if not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be at least 0 and less than the batch size")

    @property
    def slide(self) -> int:
        return self.size - self.overlap


@dataclass(frozen=True)
class FrameConfig:
    """Coordinate conversion of frames."""

    sensor_frame: str = "pandar64_0"
    vehicle_frame: str = "base_link"
    default_frame: str = "world"
    voxel: float = 0.3


@dataclass(frozen=True)
class Settings:
    """All parameters of a run; folders are relative to the root of a layout."""

    lane: LaneConfig = field(default_factory=LaneConfig)
    batch: BatchConfig = field(default_factory=BatchConfig)
    frame: FrameConfig = field(default_factory=FrameConfig)
    input_folder: str = "data/issue/global_maps"
    output_folder: str = "data/issue/converted_bin"
    pred_folder: str = "issue_laneline_pred"


# Parameter names of the files, and where each goes.
NAMES = {
    "start_index": ("batch", "start_index"),
    "input_folder": ("", "input_folder"),
    "output_folder": ("", "output_folder"),
    "pred_folder": ("", "pred_folder"),
    "crop_mode": ("lane", "crop"),
    "crop_size": ("lane", "crop_size"),
    "overlap_radius": ("lane", "overlap_radius"),
    "search_radius": ("lane", "search_radius"),
    "direction_threshold_deg": ("lane", "direction_threshold_deg"),
    "weight_distance": ("lane", "weight_distance"),
    "weight_direction": ("lane", "weight_direction"),
    "sensor_frame": ("frame", "sensor_frame"),
    "vehicle_frame": ("frame", "vehicle_frame"),
    "batch_size": ("batch", "size"),
    "overlap_size": ("batch", "overlap"),
}
#: Known names without an effect: trimming has a constant tolerance, all output has one folder.
UNUSED = {"linearity_tolerance", "package_name", "line_map_output_folder", "converted_folder"}


def _value(text: str) -> bool | int | float | str:
    text = text.strip()
    if text[:1] in "\"'" and text[-1:] == text[:1] and len(text) > 1:
        return text[1:-1]
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse(text: str) -> dict[str, bool | int | float | str]:
    """Flat ``name: value`` lines, as parameter files have them; ``#`` begins a comment outside quotes."""
    found = {}
    for number, line in enumerate(text.splitlines(), 1):
        quote, end = "", len(line)
        for i, c in enumerate(line):
            if c == quote:
                quote = ""
            elif not quote and c in "\"'":
                quote = c
            elif not quote and c == "#":
                end = i
                break
        line = line[:end].strip()
        if not line:
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"line {number} is no 'name: value'")
        found[name.strip()] = _value(value)
    return found


def settings(values: dict[str, bool | int | float | str], base: Settings = Settings()) -> Settings:
    """``base`` with named values; a name that is not known is an error."""
    if unknown := values.keys() - NAMES.keys() - UNUSED:
        raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
    changes: dict[str, dict] = {}
    for name, value in values.items():
        if name in NAMES:
            part, attribute = NAMES[name]
            of = getattr(base, part) if part else base
            kind = type(getattr(of, attribute))
            if kind is bool and not isinstance(value, bool):
                raise ValueError(f"{name} is true or false")
            changes.setdefault(part, {})[attribute] = kind(value)
    own = {k.strip("/"): v for k, v in changes.pop("", {}).items()}
    return replace(base, **{part: replace(getattr(base, part), **new) for part, new in changes.items()}, **{k: v.strip("/") for k, v in own.items()})


def read_settings(path: str, base: Settings = Settings()) -> Settings:
    return settings(parse(Path(path).read_text()), base)
