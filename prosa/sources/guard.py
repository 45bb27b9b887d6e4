"""Rules for rows, counted by the job that writes them and checked before the rows become part of a table."""

from __future__ import annotations

from functools import reduce
from typing import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class BrokenRules(ValueError):
    """A write was refused; ``counts`` has the rows that break each rule."""

    def __init__(self, name: str, counts: Mapping[str, int]):
        super().__init__(f"{name} not written, rows that break a rule: {dict(counts)}")
        self.counts = dict(counts)


class Guard:
    """``rules`` name the rows that must not be written; a condition that is null counts as false.

    The counts are observed metrics of the write, so they need no pass of their own. A stage that runs again after a lost executor may
    count a row twice, never not at all, so a write that passes has no such row.
    """

    def __init__(self, rules: Mapping[str, Column] | None):
        self.rules = {name: F.coalesce(rule, F.lit(False)) for name, rule in (rules or {}).items()}
        self.seen = Observation()

    def watch(self, df: DataFrame) -> DataFrame:
        if not self.rules:
            return df
        return df.observe(self.seen, *[F.count_if(rule).alias(name) for name, rule in self.rules.items()])

    def check(self, name: str, written: DataFrame) -> None:
        """After the write: raises if a rule was broken. Spark gives no metrics where it found, while running, that there are no
        rows and cut the plan short; then the rows ``written`` are counted instead."""
        if not self.rules:
            return
        try:
            counts = self.seen.get
        except Py4JJavaError:
            counts = written.agg(*[F.count_if(rule).alias(rule_name) for rule_name, rule in self.rules.items()]).first().asDict()
        if any(counts.values()):
            raise BrokenRules(name, counts)

    def stopping(self, df: DataFrame) -> DataFrame:
        """Rows that fail the job at the first broken rule, for a format that commits at the end of the write."""
        if not self.rules:
            return df
        broken = reduce(lambda a, b: a | b, self.rules.values())
        return df.where(F.when(broken, F.raise_error(F.lit("a row breaks a rule")).cast("boolean")).otherwise(F.lit(True)))
