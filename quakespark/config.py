"""Settings in layers: defaults, then a project, a file, single values and options. Unknown names are errors."""

from __future__ import annotations

import copy
import json
from pathlib import Path

DEFAULTS: dict = {
    "grid": None, "starting_model": "auto", "outside_data": "exclude", "min_phases_per_event": 4, "automatic_picks": "if_few_analyst_picks", "output_formats": ["csv"],
    "tomography": {"iterations": 5, "damping": 20.0, "smoothing": 20.0, "vertical_smoothing": 0.1, "damping_hypocentre": 1.0, "damping_station": 5.0, "joint_hypocentres": True, "station_terms": False, "layered": False, "straight": False, "max_step": 0.1, "outlier_mads": 4.0, "outlier_floor_s": 0.3, "max_residual_s": 5.0, "solver_turns": 400, "halvings": 3, "adaptive": False, "cell_nodes": 8, "cell_depth_nodes": 4, "cell_hits": 10.0, "ratio": False, "regularisation": "laplacian", "edge_scale": 1.0, "double_difference_weight": 1.0, "max_separation_km": 10.0, "cutoff_s": 1.0},
    "attenuation": {"damping": 2.0, "smoothing": 10.0, "vertical": 0.1, "station_terms": True, "damping_station": 3.0, "turns": 20, "q_min": 10.0, "q_max": 5000.0, "outlier_mads": 4.0},
    "locator": {"coarse": 8000, "turns": 20, "outlier_mads": 4.0, "outlier_floor": 0.5},
    "picker": {"low_hz": 2.0, "high_hz": 15.0, "trigger_on": 3.5, "window_s": 3.0, "window_per_second": 0.08, "pick_s": True, "min_snr": 3.0, "zero_phase": False},
    "double_differences": {"iterations": 3, "max_separation_km": 10.0, "cutoff_s": 1.0, "damping": 1.0},
    "lcurve": {"dampings": [1, 2, 5, 10, 20, 50, 100, 200, 500], "smoothings": [5, 20, 80]},
    "resolution": {"pattern": "checkerboard", "phase": "P", "ratio": False, "spikes": [], "bodies": [], "cell_km": 10.0, "cell_depth_km": 6.0, "amplitude_percent": 5.0, "noise_p": 0.03, "noise_s": 0.06, "seed": 1},
    "waveforms": {"before_s": 30.0, "after_s": 120.0},
    "mechanism": {"step": 5.0, "error_fraction": 0.1, "least": 10},
    "stress": {"realizations": 2000, "seed": 17031},
    "crosscorr": {"max_separation_km": 3.0, "max_neighbours": 40, "max_station_km": 60.0, "low_hz": 2.0, "high_hz": 15.0},
}


class ConfigError(ValueError):
    pass


def merge(base: dict, over: dict, where: str = "") -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        if k not in out:
            raise ConfigError(f"unknown setting {where}{k}")
        out[k] = merge(out[k], v, f"{where}{k}.") if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def set_value(config: dict, name: str, text: str) -> dict:
    """`section.name=value`; the value is JSON where it parses, else text."""
    try:
        value = json.loads(text)
    except json.JSONDecodeError:
        value = text
    over: dict = {}
    at = over
    *path, last = name.split(".")
    for p in path:
        at = at.setdefault(p, {})
    at[last] = value
    return merge(config, over)


def load(*, project: dict | None = None, file: str | None = None, sets: list[str] = ()) -> dict:
    c = copy.deepcopy(DEFAULTS)
    if project:
        c = merge(c, {k: v for k, v in project.items() if k in c})
    if file:
        c = merge(c, json.loads(Path(file).read_text(encoding="utf-8")))
    for s in sets:
        name, eq, value = s.partition("=")
        if not eq:
            raise ConfigError(f"--set takes NAME=VALUE, not {s}")
        c = set_value(c, name.strip(), value.strip())
    return c


def template() -> str:
    return json.dumps(DEFAULTS, indent=2)
