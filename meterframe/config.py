"""Job configuration (S5, P4): JSON on disk, validated eagerly on load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

# The only target definition and DST policy the reference accepts,
# and the downsample rule name it records in its metadata.
TARGET_DEFINITION = "hourly_kW_mean_of_4"
DST_POLICY = "drop_entire_transition_days"
DOWNSAMPLE_RULE = "mean_of_4_consecutive_15min_kW"


@dataclass(frozen=True)
class InactiveFilter:
    nonzero_rate_min: float = 0.01
    max_consecutive_zeros_hours_max: int = 720


@dataclass(frozen=True)
class SavePaths:
    master_wide_hourly_path: str
    metadata_path: str
    aggregate_hourly_path: str | None = None   # truly optional (T9)
    client_stats_path: str | None = None       # ours: per-series diagnostics
    master_layout: str = "wide"                # ours: "wide" (one column per series), "blocks" (column blocks) or "long"
    client_list_path: str | None = None        # S12: ids of the active series, CSV
    calendar_path: str | None = None           # S13: calendar columns of the hours, CSV
    splits_path: str | None = None             # S13: long and blocked exports by split (needs splits)
    inline_lists: bool = True                  # ours: per-series lists in the metadata document;
                                               # if false they are in client_stats_path only


@dataclass(frozen=True)
class PreprocessConfig:
    input_path: str
    analysis_window: tuple[str, str]
    save: SavePaths
    target_definition: str = TARGET_DEFINITION
    timezone: str = "Europe/Lisbon"
    decimal: str = ","
    sep: str = ";"
    dst_policy: str = DST_POLICY
    inactive_filter: InactiveFilter = field(default_factory=InactiveFilter)
    step_seconds: int = 900
    splits: dict | None = None                 # bounds of the splits: arguments of panel.SplitBounds

    def __post_init__(self):
        if self.save.splits_path and not self.splits:
            raise ValueError("splits_path needs splits")
        if self.target_definition != TARGET_DEFINITION:
            raise ValueError(f"unsupported target_definition {self.target_definition!r}; "
                             f"expected {TARGET_DEFINITION!r}")
        if self.dst_policy != DST_POLICY:
            raise ValueError(f"unsupported dst_policy {self.dst_policy!r}; expected {DST_POLICY!r}")
        if len(self.analysis_window) != 2:
            raise ValueError("analysis_window must be [start_day, end_day]")
        if self.save.master_layout not in ("wide", "blocks", "long"):
            raise ValueError(f"unknown master_layout {self.save.master_layout!r}")
        if not self.save.inline_lists and not self.save.client_stats_path:
            raise ValueError("inline_lists = false needs client_stats_path")

    @classmethod
    def from_dict(cls, d: dict) -> PreprocessConfig:
        d = dict(d)
        save = d.pop("save")
        save = SavePaths(**{k: v if v != "" else None for k, v in save.items()})
        inactive = InactiveFilter(**d.pop("inactive_filter", {}))
        window = tuple(d.pop("analysis_window"))
        return cls(analysis_window=window, save=save, inactive_filter=inactive, **d)

    def to_dict(self) -> dict:
        out = asdict(self)
        out["analysis_window"] = list(self.analysis_window)
        return out


def load_config(path: str) -> PreprocessConfig:
    with open(path, encoding="utf-8") as f:
        return PreprocessConfig.from_dict(json.load(f))
