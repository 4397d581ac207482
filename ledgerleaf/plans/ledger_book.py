"""A ledger run: lines in, marts out. Marts that several reports share are written once and then scanned."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ledgerleaf.operators.ledger import accounts as acc
from ledgerleaf.operators.ledger import checks, postings, quality, settlement
from ledgerleaf.settings import LedgerSettings
from ledgerleaf.store import packed_table


class LedgerBook:
    def __init__(
        self,
        lines: DataFrame,
        chart: DataFrame | None = None,
        overrides: DataFrame | None = None,
        cfg: LedgerSettings = LedgerSettings(),
    ) -> None:
        self.lines = lines
        self.chart = chart
        self.overrides = overrides
        self.cfg = cfg
        self._narrow: dict[tuple[str, ...], DataFrame] = {}

    def write_lines(self) -> None:
        """Write the lines, for runs that read them many times: each reading of a plan would derive them again."""
        self.lines = packed_table(self.lines, "lines")

    @cached_property
    def accounts(self) -> DataFrame:
        """Written, so that the join to the lines is planned on the dimension's real size."""
        return packed_table(acc.classify_accounts(self.lines, self.chart, self.overrides, self.cfg), "accounts")

    @cached_property
    def postings_plan(self) -> DataFrame:
        """The roll-up as a plan, for reports that read it once."""
        return postings.build_postings(self.lines, self.accounts, self.cfg)

    @cached_property
    def postings(self) -> DataFrame:
        """The roll-up as a table, for marts that read it more than once."""
        return packed_table(self.postings_plan, "postings")

    def postings_with(self, columns: tuple[str, ...]) -> DataFrame:
        """The roll-up as a table of some columns; what only the others need is not computed. A whole table serves as well."""
        if "postings" in self.__dict__:
            return self.postings
        if columns not in self._narrow:
            self._narrow[columns] = packed_table(self.postings_plan.select(*columns), "postings")
        return self._narrow[columns]

    @cached_property
    def flags_plan(self) -> DataFrame:
        return checks.all_flags(self.postings_with(checks.POSTING_COLUMNS), self.lines, self.cfg)

    @cached_property
    def flags(self) -> DataFrame:
        return packed_table(self.flags_plan, "flags")

    def settlements_by(self, method: str) -> DataFrame:
        return settlement.settle(self.postings_with(settlement.POSTING_COLUMNS), method, self.cfg)

    @cached_property
    def settlements(self) -> DataFrame | None:
        method = settlement.settlement_method(self.postings_with(settlement.POSTING_COLUMNS))
        return None if method is None else packed_table(self.settlements_by(method), "settlements")

    @cached_property
    def quality(self) -> DataFrame:
        return quality.quality_summary(self.lines, self.postings, self.accounts)
