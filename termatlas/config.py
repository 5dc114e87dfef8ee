"""Scan configuration: which terms, which thresholds, which inputs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from pathlib import Path
from typing import Any


@dataclass(frozen=True)
class Pattern:
    """A labelled, ordered pattern in Python syntax; ambiguous ones count only near the config's needle."""

    ord: int
    label: str
    source: str
    ambiguous: bool = False


@dataclass(frozen=True)
class ScanConfig:
    min_chars: int = 500
    domain_cap: int = 50
    window: int = 200
    needle: str = "autism"
    patterns: tuple[Pattern, ...] = ()
    #: Sampling needs one; a scan does not.
    seed: int | None = None
    crawl_ids: tuple[str, ...] = ()
    files_per_crawl: int = 2
    out_dir: str = "data/interim"
    #: Columns that put documents into scan order; the label order follows them.
    order: tuple[str, ...] = ("source_wet", "record_idx")
    extra: dict = field(default_factory=dict, compare=False)

    def with_(self, **changes: Any) -> ScanConfig:
        return replace(self, **changes)


def term_patterns(terms: dict[str, Any]) -> tuple[Pattern, ...]:
    """Patterns in scan order: the two lists, then the ambiguous one. A missing or empty entry adds nothing."""
    out: list[Pattern] = []
    for name in ("adhd_patterns", "autism_patterns"):
        out += [Pattern(len(out) + i, f"{name}[{i}]", p) for i, p in enumerate(terms.get(name) or [])]
    if terms.get("asd_pattern"):
        out.append(Pattern(len(out), "asd_pattern", terms["asd_pattern"], ambiguous=True))
    return tuple(out)


def from_dict(raw: dict[str, Any]) -> ScanConfig:
    """A config from the nested mapping of a YAML file; filters and terms have to be there."""
    filters, terms = raw["filters"], raw["terms"]
    project, pilot, sampling = (raw.get(k) or {} for k in ("project", "pilot", "sampling"))
    return ScanConfig(
        min_chars=int(filters["min_chars"]),
        domain_cap=int(filters["domain_cap"]),
        window=int(filters["asd_disambiguation_window_chars"]),
        patterns=term_patterns(terms),
        seed=int(project["seed"]) if "seed" in project else None,
        crawl_ids=tuple(pilot.get("crawl_ids") or ()),
        files_per_crawl=int(sampling.get("wet_files_per_crawl", 2)),
        out_dir=str(project.get("out_dir", "data/interim")),
    )


def load(path: str | Path) -> ScanConfig:
    import yaml

    return from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
