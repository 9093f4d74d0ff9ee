"""Settings: every one with its default, and an environment variable of the same name in capitals."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    sensor: str = "ouster"
    target: str = ""
    azimuth: str = "0 360"
    lidar_mode: str = "1024x10"
    timestamp_mode: str = "internal"
    msop_port: int = 6699
    difop_port: int = 7788
    include_noisy: bool = False
    discover: bool = False
    topic: str = "rt/lidar"
    frame_id: str = "lidar"
    base_frame_id: str = "base_link"
    tf_vec: str = "0 0 0"
    tf_quat: str = "0 0 0 1"
    clustering: str = ""
    cluster_eps: int = 200
    cluster_minpts: int = 4
    cluster_bridge: int = 0
    ground_filter: bool = False
    ground_thickness: int = 150
    sensor_height: float | None = None
    mirror: str = "off"
    keep_latest: bool = False

    @classmethod
    def read(cls, given: dict | None = None, env: dict | None = None) -> Settings:
        """Given values win over environment variables, those over the defaults."""
        env, out = os.environ if env is None else env, {}
        for f in fields(cls):
            raw = (given or {}).get(f.name, env.get(f.name.upper()))
            if raw is None:
                continue
            kind = str(f.type)
            out[f.name] = str(raw).lower() in ("1", "true", "yes", "on") if kind == "bool" else int(raw) if kind == "int" else (float(raw) if str(raw) else None) if "float" in kind else str(raw)
        made = cls(**out)
        if made.sensor not in ("ouster", "robosense"):
            raise ValueError(f"sensor: {made.sensor}")
        if made.clustering not in ("", "dbscan", "voxel"):
            raise ValueError(f"clustering: {made.clustering}")
        return made

    def numbers(self, name: str, count: int) -> tuple[float, ...]:
        """A setting of ``count`` numbers with blanks or commas between them."""
        found = tuple(float(x) for x in str(getattr(self, name)).replace(",", " ").split())
        if len(found) != count:
            raise ValueError(f"{name}: {count} numbers, not {getattr(self, name)!r}")
        return found
