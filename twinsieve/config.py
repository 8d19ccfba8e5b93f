"""Settings of a scan."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

METHODS = ("phash", "dhash", "ahash", "whash", "histogram", "ssim", "orb", "gpu")


@dataclass(frozen=True)
class ScanConfig:
    folders: tuple[str, ...] = ()
    recursive: bool = True
    method: str = "phash"
    threshold: float = 0.85
    strategy: str = "keep_first"
    video_enabled: bool = False
    video_method: str = "gpu"
    video_threshold: float = 0.90
    video_fps: float = 1.0
    video_max_frames: int = 32
    video_min_frames: int = 4

    def __post_init__(self):
        for method in (self.method, self.video_method):
            if method not in METHODS:  # it may have been registered
                from twinsieve.plans import registry

                registry.method(method)
        if not 0 <= self.threshold <= 1 or not 0 <= self.video_threshold <= 1:
            raise ValueError("thresholds lie between 0 and 1")
        if self.video_fps <= 0 or self.video_max_frames < 1:
            raise ValueError("frame settings must be positive")

    def frames(self) -> tuple[int, int]:
        """Least and most frames of a video; the most is raised to the least, which is at least 1."""
        least = max(1, self.video_min_frames)
        return least, max(least, self.video_max_frames)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> "ScanConfig":
        known = {f.name for f in fields(cls)}
        found = {k: tuple(v) if k == "folders" else v for k, v in json.loads(text).items() if k in known}
        return replace(cls(), **found)


def slider_to_threshold(position: int) -> float:
    """A threshold slider has whole steps 50 to 100."""
    return min(100, max(50, int(position))) / 100.0


def threshold_to_slider(threshold: float) -> int:
    """The nearest step, so that a threshold survives being stored and shown again."""
    return min(100, max(50, round(threshold * 100)))


def slider_to_fps(position: int) -> float:
    return min(10, max(1, int(position))) / 2.0


def slider_to_max_frames(position: int) -> int:
    return min(16, max(1, int(position))) * 8
