"""Stage plans: an ordered list of DataFrame transformations with named results."""

from __future__ import annotations

import logging
import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame

log = logging.getLogger(__name__)


@dataclass
class Stage:
    """``run`` gets the nearest earlier result; ``needs``: one of these results must exist, if any are named."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    critical: bool = False
    barrier: bool = False


@dataclass
class Pipeline:
    """Optional stages that fail to plan are left out, critical ones raise.

    Plans are lazy: what fails at run time has to fail per row (``try_*``, error columns). A ``barrier``
    stage is materialised through ``checkpoint`` and so fails here, too.
    """

    stages: list[Stage] = field(default_factory=list)

    def add(self, name: str, run: Callable[[DataFrame], DataFrame], **options) -> Pipeline:
        self.stages = [s for s in self.stages if s.name != name] + [Stage(name, run, **options)]
        return self

    def run(self, source: DataFrame | None = None, results: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All results by name. ``results`` injects the outcome of earlier stages, to start in the middle."""
        done = dict(results or {})
        if source is not None:
            done.setdefault("input", source)
        for stage in self.stages:
            if stage.name in (results or {}):
                continue
            given = [done[n] for n in stage.needs if n in done] if stage.needs else list(done.values())[-1:]
            try:
                if not given:
                    raise LookupError(f"{stage.name} needs one of {stage.needs or ('input',)}")
                out = stage.run(given[0])
                done[stage.name] = out.checkpoint() if stage.barrier else out
            except (LookupError, ValueError, PySparkException) as e:
                if stage.critical:
                    raise
                log.warning("stage %s left out: %s", stage.name, e)
        return done

    def last(self, results: dict[str, DataFrame]) -> DataFrame | None:
        return next((results[s.name] for s in reversed(self.stages) if s.name in results), None)


def check_environment(required: dict[str, str], optional: dict[str, str] | None = None) -> None:
    """Raise if one of the ``required`` files (what it is for -> path) is missing; a missing optional one is a warning."""
    if missing := {k: p for k, p in required.items() if not os.path.exists(p)}:
        raise FileNotFoundError(f"missing: {missing}")
    for what, path in (optional or {}).items():
        if not os.path.exists(path):
            log.warning("%s: %s is missing; stages that need it are left out", what, path)


class Recognisers:
    """Registry of pluggable recognisers; one that is missing leaves cells as they are."""

    BACKENDS = ("tesseract", "keras", "yolo")

    def __init__(self) -> None:
        self._known: dict[str, Callable[[DataFrame], DataFrame]] = {}

    def register(self, name: str, transform: Callable[[DataFrame], DataFrame]) -> None:
        self._known[name] = transform

    def stage(self, name: str) -> Callable[[DataFrame], DataFrame]:
        return self._known.get(name, lambda cells: cells)

    @classmethod
    def backends(cls, chosen: str | None = None) -> list[str]:
        names = [x.strip().lower() for x in (chosen or "tesseract,yolo").split(",") if x.strip()]
        if unknown := set(names) - set(cls.BACKENDS):
            raise ValueError(f"unknown backends: {sorted(unknown)}")
        return names
