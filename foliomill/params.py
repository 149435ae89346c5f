"""Every tuning number in one frozen object, and the key under which derived rows are kept."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Params:
    """Distances are points. They decide results."""

    size_eps: float = 0.1
    baseline_eps: float = 0.6
    kerning: float = -1.0
    gap_ratio: float = 0.35
    touch: float = 0.1
    tall_art_lines: int = 4
    letter_spacing_least: float = 0.015
    letter_spacing_apart: float = 0.015
    copy_shared_letters: int = 3
    copy_width_apart: float = 1.0
    too_long: float = 4.0
    room_slack: float = 0.1
    condense_limit: float = 0.05
    shrink_floor: float = 0.9
    space_em: float = 0.25
    green_target: float = 0.8
    green_warn: float = 0.5
    glyph_apart: float = 0.05

    def build_key(self) -> str:
        """Changes whenever any number does."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()


DEFAULTS = Params()
