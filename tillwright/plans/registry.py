"""All registered receipt queries: importing the modules below registers theirs."""

from __future__ import annotations

from . import files, kernels, label_steps, more, processed, review, values  # noqa: F401
from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
