"""Run parameters and presets."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Modes, statuses and thresholds that results depend on.
MODE_DISABLED = "disabled"
MODE_ONLY = "fast_path_only"
MODE_FALLBACK = "fast_path_with_fallback"
FAST_PATH_MODES = (MODE_DISABLED, MODE_ONLY, MODE_FALLBACK)

INITIALIZING = "initializing"
RUNNING = "running"
FINISHED = "finished"
FAILED = "failed"
CANCELLED = "cancelled"

REDUCE_ABOVE_CHARS = 10000
HIGH_COST = 10.0
BUDGET_COST = 100.0
MIN_EXTRACTIONS = 1
CONFIDENCE = 0.7
RELAXED_CONFIDENCE = 0.5
SEARCH_CACHE_SECONDS = 3600

# Vendor search addresses; the entity name is appended as it is.
VENDOR_SEARCH_URLS = {
    "digikey": "https://www.digikey.com/en/products/result?keywords=",
    "mouser": "https://www.mouser.com/Search/Refine?Keyword=",
}


@dataclass(frozen=True)
class Field:
    """One wanted field: what to look for and how to recognise its value.

    ``pattern`` has one group for the value and is matched against the filtered
    text, or against the page body itself if ``on_page``.  A value that does not
    fit ``validator`` is dropped.  ``keywords`` mark the blocks worth keeping.
    """

    name: str
    desc: str
    example: str | None = None
    pattern: str | None = None
    keywords: tuple[str, ...] = ()
    on_page: bool = False
    validator: str | None = None

    def __post_init__(self):
        if not self.name.strip() or not self.desc.strip():
            raise ValueError("a wanted field needs a name and a description")

    @property
    def search_words(self) -> tuple[str, ...]:
        return tuple(w.lower() for w in (self.keywords or (self.name,)))


@dataclass(frozen=True)
class FastPath:
    mode: str = MODE_DISABLED
    domains: tuple[str, ...] = ("digikey",)
    min_result_size: int = 1000
    # The documented meaning of "with fallback" is to stop after a success;
    # True reproduces runs that always take the normal way as well.
    always_continue: bool = False

    def __post_init__(self):
        if self.mode not in FAST_PATH_MODES:
            raise ValueError(f"mode must be one of {FAST_PATH_MODES}")
        unknown = set(self.domains) - set(VENDOR_SEARCH_URLS)
        if unknown:
            raise ValueError(f"unknown domains {sorted(unknown)}")


@dataclass(frozen=True)
class RunConfig:
    top_k: int = 10
    interleave: bool = True
    deduplicate: bool = True
    min_page_chars: int = 5000
    strategy: str = "contextual"
    trim_chars: int | None = None
    reduce_above: int = REDUCE_ABOVE_CHARS
    fetch_partitions: int = 5
    confidence: float = CONFIDENCE
    relaxed_confidence: float = RELAXED_CONFIDENCE
    min_extractions: int = MIN_EXTRACTIONS
    budget_cost: float = BUDGET_COST
    fast_path: FastPath = field(default_factory=FastPath)

    def __post_init__(self):
        if self.top_k < 1:
            raise ValueError("top_k must be at least 1")


def default_config() -> RunConfig:
    return RunConfig()


def fast_only_config() -> RunConfig:
    return RunConfig(fast_path=FastPath(mode=MODE_ONLY))


def fast_with_fallback_config() -> RunConfig:
    return RunConfig(top_k=5, fast_path=FastPath(mode=MODE_FALLBACK, min_result_size=5000))


def development_config() -> RunConfig:
    return replace(default_config(), top_k=5, min_page_chars=3000)


def production_config() -> RunConfig:
    return RunConfig(
        top_k=15,
        min_page_chars=10000,
        fast_path=FastPath(mode=MODE_FALLBACK, min_result_size=10000),
    )
