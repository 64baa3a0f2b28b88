"""Experiments: erase, impute, score, report."""

from .experiment import ERASING, METHODS, PERCENTS, Report, compare_grid, impute, run_experiment
from .presets import HEADACHE, IRIS, Preset

__all__ = [
    "ERASING",
    "HEADACHE",
    "IRIS",
    "METHODS",
    "PERCENTS",
    "Preset",
    "Report",
    "compare_grid",
    "impute",
    "run_experiment",
]
