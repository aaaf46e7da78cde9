"""Settings of the flows: one flat record with layers, checks and text options.

Layers are defaults, a mapping read from YAML, then options given by hand; later ones win. Unknown names are
errors. Settings that only start and tune a model server have no use here and are not carried.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Settings:
    """What the detection, relabelling and live flows need."""

    # Defaults and allowed values below are fixed values.
    task: str = "free_detection"
    images: tuple[str, ...] = ()
    train_image: str | None = None
    train_label: str | None = None
    yaml_path: str | None = None
    image_extensions: str = ".jpg,.jpeg,.png"
    categories: str = "person, car, bicycle, dog, cat"
    definitions: str = ""
    conf_threshold: int = 2
    output_folder: str = "./detection_results"
    inplace_saving: bool = False
    num_samples: int | None = None
    shuffle: bool = False
    seed: int = 42
    start_index: int | None = None
    end_index: int | None = None
    batch_size: int = 0
    resume: bool = False
    auto_resume: bool = True
    max_workers: int = 1
    max_rounds: int = 2
    score_threshold: int = 8
    api_retries: int = 3
    height: int = 1024
    width: int = 1024
    gpu_memory_utilization: float = 0.90
    prep_enabled: bool = False
    prep_short_edge: int = 1024
    prep_pad_square: bool = False
    prep_contrast_method: str = "none"
    prep_gamma: float = 1.0
    prep_denoise_method: str = "none"
    prep_sharpen: bool = False
    prep_white_balance: bool = False
    prep_grid_style: str = "standard"
    prep_grid_step: int = 100
    prep_som_enabled: bool = False
    prep_tiling_enabled: bool = False
    prep_tile_size: int = 512
    prep_tile_overlap: float = 0.2
    prep_crop_verify_enabled: bool = False
    prep_crop_padding: float = 0.15
    prep_send_pixel_bounds: bool = False
    prep_min_pixels: int = 200_704
    prep_max_pixels: int = 4_194_304
    serving_extra: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}, not {getattr(self, name)!r}")
        if not 0 <= self.prep_tile_overlap <= 0.5:
            raise ValueError("prep_tile_overlap must be within 0 and 0.5")
        if not 0 < self.gpu_memory_utilization <= 1:
            raise ValueError("gpu_memory_utilization must be over 0 and at most 1")
        if self.start_index is not None and self.start_index < 0:
            raise ValueError("start_index must not be negative")
        if self.end_index is not None and self.end_index <= (self.start_index or 0):
            raise ValueError("end_index must be over start_index")
        if self.task == "auto_label" and not (self.train_image and self.train_label and self.yaml_path):
            raise ValueError("auto_label needs train_image, train_label and yaml_path")

    def preprocessing(self) -> dict[str, Any]:
        """What is done to an image, by name; with preprocessing off, only the grid and the request hints stay as they are set."""
        every = {f.name.removeprefix("prep_"): getattr(self, f.name) for f in dataclasses.fields(self) if f.name.startswith("prep_")}
        if not every.pop("enabled"):
            held = ("grid_style", "grid_step", "send_pixel_bounds", "min_pixels", "max_pixels")
            off = {f.name.removeprefix("prep_"): f.default for f in dataclasses.fields(self) if f.name.startswith("prep_")}
            every |= {k: off[k] for k in every if k not in held}
            every["resolution"] = False
        else:
            every["resolution"] = True
        return every

    def category_list(self) -> list[str]:
        return [c for c in (part.strip() for part in self.categories.split(",")) if c]

    def pixel_bounds(self, external: bool) -> dict[str, int]:
        """Request hints on image size; external services take none."""
        return {"min_pixels": self.prep_min_pixels, "max_pixels": self.prep_max_pixels} if self.prep_send_pixel_bounds and not external else {}


CHOICES = {
    "task": ("free_detection", "auto_label"),
    "conf_threshold": (1, 2, 3, 4, 5),
    "prep_contrast_method": ("none", "clahe", "autocontrast"),
    "prep_denoise_method": ("none", "bilateral", "nlm"),
    "prep_grid_style": ("standard", "transparent", "fine", "none"),
}


def layered(*layers: dict[str, Any]) -> Settings:
    """Settings of ``layers``, the last of which wins."""
    merged: dict[str, Any] = {}
    for layer in layers:
        if not isinstance(layer, dict):
            raise ValueError("settings must be a mapping")
        merged |= layer
    known = {f.name for f in dataclasses.fields(Settings)}
    if extra := sorted(merged.keys() - known):
        raise ValueError(f"unknown settings: {', '.join(extra)}")
    if "images" in merged:
        merged["images"] = tuple(merged["images"])
    return Settings(**merged)


def from_file(path: str) -> dict[str, Any]:
    """The layer in a YAML file, which must be a mapping; an empty file is an empty one."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("settings files need a YAML library") from missing
    with open(path, encoding="utf-8") as f:
        layer = yaml.safe_load(f)
    if layer is None:
        return {}
    if not isinstance(layer, dict):
        raise ValueError(f"{path} must hold a mapping")
    return layer


def key_values(tokens: list[str] | None) -> dict[str, Any]:
    """Options given as ``key=value``: true and false, integers, floats, else text."""
    out: dict[str, Any] = {}
    for token in tokens or ():
        key, equals, value = token.partition("=")
        key, value = key.strip(), value.strip()
        if not equals or not key:
            raise ValueError(f"expected key=value, got {token!r}")
        out[key] = _typed(value)
    return out


def _typed(value: str) -> Any:
    if value.lower() in ("true", "false"):
        return value.lower() == "true"
    for kind in (int, float):
        try:
            return kind(value)
        except ValueError:
            continue
    return value
