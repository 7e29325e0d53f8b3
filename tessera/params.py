"""Parameters of a curation run."""

from dataclasses import dataclass

#: Images wanted by the named strategies; None stands for an automatic number.
STRATEGIES = {"adaptive": None, "auto": None, "standard": 30, "broad": 100}


@dataclass(frozen=True)
class CurationParams:
    """Settings of a run with their defaults."""

    years: int = 10
    min_face_count: int = 0
    min_confidence: float = 0.7
    min_face_px: int = 50
    blur_threshold: float = 120.0
    max_per_person: int = 90
    max_auto: int = 5
    page_cap: int = 5000
    pool_cap: int = 3000
    duplicate_distance: float = 0.20
    hard_confidence: float = 0.85
    threshold_floor: float = 0.05
    threshold_share: float = 0.20


def resolve_strategy(name: str, limit: str | int | None = None, embedder: bool = True) -> tuple[int | None, str]:
    """(number of images or None for automatic, mode) of a strategy name and an optional explicit limit.

    ``skip`` selects nothing; without an embedder selection is spread over time (30 unless the limit is a positive
    number); a positive limit overrides the strategy; unknown names count as automatic.
    """
    if name == "skip":
        return 0, "skip"
    try:
        number = int(limit) if limit is not None else 0
    except ValueError:
        number = 0
    if not embedder:
        return (number if number > 0 else 30), "time"
    if number > 0:
        return number, "smart"
    return STRATEGIES.get(name), "smart"
