"""Configuration as dataclasses, checked up front: unknown keys, ranges, overlaps and duplicates are errors."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields


@dataclass
class Destination:
    path: str
    mode: str = "archive"


@dataclass
class Job:
    name: str
    source: str
    destinations: list[Destination] = field(default_factory=list)
    verification: str = "date_and_size"
    max_file_size_mb: float = 0
    exclude: list[str] = field(default_factory=list)
    hold_days: int = 7
    guard_count: int = 0
    guard_percent: float = 50.0


def _make(kind, data: dict, where: str):
    known = {f.name for f in fields(kind)}
    if unknown := set(data) - known:
        raise ValueError(f"{where}: unknown keys {sorted(unknown)}")
    try:
        return kind(**data)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


def _no_duplicates(pairs):
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError(f"duplicate keys among {[k for k, _ in pairs]}")
    return out


def load(text: str) -> list[Job]:
    """Jobs of a JSON document (a list of objects)."""
    jobs = []
    for n, data in enumerate(json.loads(text, object_pairs_hook=_no_duplicates)):
        job = _make(Job, data, f"job {n}")
        job.destinations = [_make(Destination, d, f"job {job.name}") for d in job.destinations]
        jobs.append(job)
    validate(jobs)
    return jobs


def validate(jobs: list[Job]) -> None:
    seen: dict[str, str] = {}
    for job in jobs:
        if job.verification not in ("none", "size", "date_and_size", "hash", "full"):
            raise ValueError(f"job {job.name}: no verification {job.verification!r}")
        if job.hold_days < 0 or job.guard_count < 0 or not 0 <= job.guard_percent <= 100:
            raise ValueError(f"job {job.name}: a limit is out of range")
        for d in job.destinations:
            key = d.path.rstrip("/\\").lower()
            if key in seen:
                raise ValueError(f"{d.path}: a destination of {seen[key]} and of {job.name}")
            seen[key] = job.name
            root = job.source.rstrip("/\\").lower()
            if key == root or key.startswith(root + "/") or root.startswith(key + "/"):
                raise ValueError(f"job {job.name}: source and destination overlap")
