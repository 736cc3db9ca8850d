"""Job, dimension, fact and view specifications, read from JSON and validated before anything runs."""

from __future__ import annotations

import json
import re
from dataclasses import MISSING, dataclass, field, fields
from typing import Any

NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


class ConfigError(ValueError):
    pass


def _made(kind, raw: dict[str, Any]):
    known = {f.name: f for f in fields(kind)}
    if extra := set(raw) - set(known):
        raise ConfigError(f"{kind.__name__}: unknown fields {sorted(extra)}")
    needed = {n for n, f in known.items() if f.default is MISSING and f.default_factory is MISSING}
    if lacking := needed - set(raw):
        raise ConfigError(f"{kind.__name__}: fields {sorted(lacking)} are missing")
    out = kind(**raw)
    out.check()
    return out


def _named(*names: str) -> None:
    for n in names:
        if not NAME.match(n):
            raise ConfigError(f"not an identifier: {n!r}")


@dataclass(frozen=True)
class JobSpec:
    job_id: str
    source_file_name: str
    target_table: str
    upsert_keys: list[str]
    job_name: str = ""
    glue_job: str = "simple"
    schema_name: str = "public"
    is_active: bool = True

    def check(self):
        _named(self.target_table, self.schema_name, *self.upsert_keys)
        if self.glue_job not in ("simple", "data_model"):
            raise ConfigError(f"glue_job is simple or data_model, not {self.glue_job!r}")
        if not self.upsert_keys:
            raise ConfigError(f"{self.job_id}: upsert_keys is empty")


@dataclass(frozen=True)
class DimSpec:
    dimension_table: str
    natural_keys: list[str]
    column_mappings: dict[str, str]
    scd_type: int = 2
    scd_attributes: list[str] = field(default_factory=list)

    def check(self):
        _named(self.dimension_table, *self.column_mappings)
        if self.scd_type not in (0, 1, 2, 3):
            raise ConfigError(f"{self.dimension_table}: scd_type {self.scd_type}")
        if lost := (set(self.natural_keys) | set(self.scd_attributes)) - set(self.column_mappings):
            raise ConfigError(f"{self.dimension_table}: unmapped columns {sorted(lost)}")

    @property
    def key(self) -> str:
        return self.dimension_table.replace("dim_", "") + "_key"


@dataclass(frozen=True)
class FactSpec:
    fact_table: str
    dimension_lookups: list[dict[str, Any]]
    measures: list[str]
    measure_mappings: dict[str, str] = field(default_factory=dict)
    degenerate_dimensions: list[str] = field(default_factory=list)
    degenerate_mappings: dict[str, str] = field(default_factory=dict)
    fact_type: str = "transaction"
    #: The business day: date_key comes from it where a lookup asks for one that the feed lacks.
    date_column: str = "report_date"

    def check(self):
        _named(self.fact_table, *self.measures, *self.degenerate_dimensions)
        if self.fact_type not in ("transaction", "periodic_snapshot"):
            raise ConfigError(f"{self.fact_table}: fact_type {self.fact_type!r}")
        for look in self.dimension_lookups:
            if not {"dimension", "natural_keys", "surrogate_key"} <= set(look) or set(look) - {"dimension", "natural_keys", "surrogate_key", "as_of"}:
                raise ConfigError(f"{self.fact_table}: a lookup has dimension, natural_keys, surrogate_key and perhaps as_of (a day column)")

    @property
    def mapping(self) -> dict[str, str]:
        return {c: self.measure_mappings.get(c, c) for c in self.measures} | {c: self.degenerate_mappings.get(c, c) for c in self.degenerate_dimensions}


@dataclass(frozen=True)
class ViewSpec:
    view_name: str
    source_table: str
    definition: str
    schema_name: str = "public"

    def check(self):
        _named(self.view_name, self.source_table, self.schema_name)

    def sql(self) -> str:
        """The definition with its names filled in: {view_name}, {source_table}, {schema_name}."""
        return self.definition.format(view_name=self.view_name, source_table=self.source_table, schema_name=self.schema_name)


def _unique(specs: list, name: str) -> list:
    seen: dict[str, int] = {}
    for s in specs:
        seen[getattr(s, name)] = seen.get(getattr(s, name), 0) + 1
    if twice := [k for k, n in seen.items() if n > 1]:
        raise ConfigError(f"{name} occurs twice: {twice}")
    return specs


def jobs(text: str) -> list[JobSpec]:
    return _unique([_made(JobSpec, r) for r in json.loads(text)], "job_id")


def views(text: str) -> dict[str, ViewSpec]:
    """By view name; the last definition of a name counts."""
    return {v.view_name: v for v in (_made(ViewSpec, r) for r in json.loads(text))}


def models(text: str) -> dict[str, tuple[list[DimSpec], list[FactSpec]]]:
    """{source table: (dimensions, facts)}; both may stand in an object named dimensional_model."""
    out = {}
    for raw in json.loads(text):
        model = raw.get("dimensional_model", raw)
        out[raw["source_table"]] = [_made(DimSpec, d) for d in model.get("dimensions", [])], [_made(FactSpec, f) for f in model.get("facts", [])]
    return out


def base_name(path: str) -> str:
    """The last part of a path, in the form in which file names are compared."""
    return path.rstrip("/").rsplit("/", 1)[-1].strip().lower()


def find_job(specs: list[JobSpec], path: str) -> tuple[JobSpec | None, str]:
    """(job, outcome) for a file: triggered, inactive or not_configured; base names are compared in any case."""
    for s in specs:
        if base_name(s.source_file_name) == base_name(path):
            return s, "triggered" if s.is_active else "inactive"
    return None, "not_configured"
