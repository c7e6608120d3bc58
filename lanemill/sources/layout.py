"""Where the files of a run lie, below a root and for one index."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..config import Settings


@dataclass(frozen=True)
class Layout:
    root: str
    index: int
    settings: Settings = field(default_factory=Settings)

    @property
    def roadgraph(self) -> str:
        return f"{self.root}/{self.settings.input_folder}/{self.index}.json"

    @property
    def poses(self) -> str:
        return f"{self.root}/data/sensor/{self.index}/ego_state"

    @property
    def pcd(self) -> str:
        return f"{self.root}/data/sensor/{self.index}/pcd"

    @property
    def predictions(self) -> str:
        return f"{self.root}/data/{self.settings.pred_folder}/{self.index}/{self.settings.frame.sensor_frame}"

    @property
    def out(self) -> str:
        return f"{self.root}/{self.settings.output_folder}/{self.index}"

    @property
    def frames(self) -> str:
        return f"{self.out}/pred_frames"

    @property
    def batches(self) -> str:
        return f"{self.out}/batch"

    def pose(self, frame: int) -> str:
        return f"{self.poses}/{frame}.json"

    def scan(self, frame: int) -> str:
        return f"{self.pcd}/{frame}.pcd"

    def prediction(self, frame: int) -> str:
        return f"{self.predictions}/{frame}.bin"

    def frame(self, frame: int) -> str:
        return f"{self.frames}/frame_{frame}.bin"

    def batch(self, number: int) -> str:
        return f"{self.batches}/batch_{number}.bin"

    def lanes(self, seq: int) -> str:
        return f"{self.out}/points_seq_{seq}.bin"

    def cloud(self, seq: int) -> str:
        return f"{self.out}/lidar_seq_{seq}.bin"
