"""Parameters: fixed constants, and the three confidence profiles that may change while a session runs."""

from __future__ import annotations

from dataclasses import asdict, dataclass


@dataclass(frozen=True)
class Profile:
    """Thresholds of one confidence mode. The defaults are those of `balanced`."""

    name: str = "balanced"
    auto: float = 0.75
    instant: float = 0.85
    min_raw: float = 0.70
    overlap_auto: int = 1
    overlap_evidence: int = 2
    overlap_instant: int = 1
    switch_score: float = 0.90
    switch_margin: float = 0.08
    overlap_switch: int = 1
    suggest: float = 0.60
    challenger_margin: float = 0.10
    challenger_windows: int = 3
    lock_windows: int = 2
    weak_windows: int = 3
    recovery_score: float = 0.65
    local_follow: float = 0.42
    silence_score: float = 0.82
    miss_windows: int = 4


# The other two modes.
CONSERVATIVE = Profile(
    "conservative", 0.82, 0.92, 0.74, 1, 2, 1, 0.94, 0.12, 2, 0.66, 0.14, 4, 3, 4, 0.72, 0.48, 0.90, 3
)
BALANCED = Profile()
FAST = Profile("fast", 0.68, 0.80, 0.66, 1, 1, 1, 0.86, 0.05, 1, 0.55, 0.08, 2, 1, 2, 0.58, 0.38, 0.75, 5)
PROFILES = {p.name: p for p in (CONSERVATIVE, BALANCED, FAST)}


def profile(mode: str | None) -> Profile:
    """The profile of a mode; unknown modes are balanced."""
    return PROFILES.get(mode or "", BALANCED)


def profile_rows() -> list[dict]:
    return [asdict(p) for p in PROFILES.values()]


# Fixed values of matching, windows and state.
MIN_LETTERS = 3
START_LETTERS = 8
PREFIX_LIMIT, CONTAINS_LIMIT, SUBKEY_LIMIT, PHRASE_LIMIT = 10, 10, 5, 8
SUBKEY = 4
WEIGHT_RATIO, WEIGHT_RUN, WEIGHT_CONTEXT, WEIGHT_SOURCE = 0.4, 0.3, 0.2, 0.1
BONUS_TWO, BONUS_ONE = 0.10, 0.05
TOP = 5
HYPOTHESES, HYPOTHESIS_TTL, DECAY = 5, 2, 0.85
WEAK_LINE, LOCAL_RADIUS = 0.35, 2
BYPASS = 0.88
BOOST_WINDOWS, SILENCE_WINDOWS = 3, 2
RATE_ALPHA, FAST_RATE, SLOW_RATE, SILENT_RATE = 0.35, 1.50, 0.65, 0.9
SECONDS = {
    "start_boost": 4.5,
    "locked_recover": 9.0,
    "locked_fast": 5.0,
    "locked_slow": 9.0,
    "locked_follow": 7.0,
    "search_fast": 8.0,
    "search": 10.0,
}
BLOCKS_PER_STEP, BLOCKS_PER_WINDOW = 6, 20
VOICE_RMS = 0.001
