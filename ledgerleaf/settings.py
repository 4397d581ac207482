"""Run parameters; every default is part of the result contract."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LedgerSettings:
    on_time_days: int = 7
    work_start: int = 8
    work_end: int = 17
    month_end_days: int = 5
    cash_limit: int = 1500
    dormant_max: int = 5
    very_late_days: int = 30
    fifo_grace_days: int = 5
    # Rows of each check in the detail table; all of them unless a caller sets a limit.
    detail_rows: int | None = None
    # SQL expression that orders lines over the whole input. Use "struct(SourceFile, LineNo)" for several files.
    line_order: str = "LineNo"


@dataclass(frozen=True)
class CarbonSettings:
    base_year: int
    reporting_year: int
    target_year: int = 2030
    basis: str = "Market"  # or "Location"
    include_use_phase: bool = True
    reduction_scope12: int = 42
    reduction_scope3: int = 25
    sites: tuple[str, ...] | None = None
    scopes: tuple[str, ...] = ("Scope 1", "Scope 2", "Scope 3")

    @property
    def value_column(self) -> str:
        return "tCO2e_Market" if self.basis == "Market" else "tCO2e_Location"
