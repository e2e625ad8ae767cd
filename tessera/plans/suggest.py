"""Constraint suggestion: rules over column profiles, optionally verified on a held-out part."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..checks import Check, Constraint, DetectionResult, DetectionSuite, greater_than_or_equal_to, is_one
from ..operators import analyzers as a
from .profile import NumericProfile, Profiles, StandardProfile, profile


@dataclass(frozen=True)
class ConstraintSuggestion:
    constraint: Constraint
    column: str
    current_value: str
    description: str
    rule: str
    code: str


def _one(check: Check) -> Constraint:
    return check.constraints[-1]


class Rule:
    def applies(self, p: StandardProfile, rows: int) -> bool:
        raise NotImplementedError

    def suggest(self, p: StandardProfile, rows: int) -> ConstraintSuggestion:
        raise NotImplementedError

    def made(self, constraint: Constraint, p: StandardProfile, current: str, description: str, code: str) -> ConstraintSuggestion:
        return ConstraintSuggestion(constraint, p.column, current, description, type(self).__name__, code)


class CompleteRule(Rule):
    def applies(self, p, rows):
        return p.completeness == 1.0

    def suggest(self, p, rows):
        return self.made(_one(Check("").is_complete(p.column)), p, f"Completeness: {p.completeness}", f"{p.column} is not null", f'.is_complete("{p.column}")')


class RetainCompletenessRule(Rule):
    def applies(self, p, rows):
        return 0.2 < p.completeness < 1.0

    def bound(self, p, rows):
        """Lower end of the 95 % confidence interval, to two decimals."""
        c = p.completeness
        return math.floor((c - 1.96 * math.sqrt(c * (1 - c) / rows)) * 100) / 100

    def suggest(self, p, rows):
        b = self.bound(p, rows)
        return self.made(_one(Check("").has_completeness(p.column, greater_than_or_equal_to(b))), p, f"Completeness: {p.completeness}", f"{p.column} is null in less than {round((1 - b) * 100)} % of rows", f'.has_completeness("{p.column}", greater_than_or_equal_to({b}))')


class RetainTypeRule(Rule):
    def applies(self, p, rows):
        return p.is_inferred_type and p.data_type in ("Integral", "Fractional", "Boolean")

    def suggest(self, p, rows):
        kind = p.data_type.lower()
        return self.made(_one(Check("").has_data_type(p.column, kind)), p, f"DataType: {p.data_type}", f"{p.column} holds {kind} values", f'.has_data_type("{p.column}", "{kind}")')


class CategoricalRangeRule(Rule):
    def applies(self, p, rows):
        if p.histogram is None or p.data_type != "String":
            return False
        counts = [v.absolute for k, v in p.histogram.values.items() if k != a.NULL_VALUE]
        return bool(counts) and sum(n == 1 for n in counts) / len(counts) <= 0.1

    def suggest(self, p, rows):
        values = [k for k in p.histogram.values if k != a.NULL_VALUE]
        column, listed = f"`{p.column}`", ", ".join(repr(v) for v in values)
        label = f"{p.column} contained in {','.join(values)}"
        # a null is no value outside the range
        predicate = f"{column} IS NULL OR CAST({column} AS STRING) IN ({', '.join(_sql(v) for v in values)})"
        return self.made(Constraint("Compliance", a.Compliance(label, predicate, None, (p.column,)), is_one()), p, f"Values: {listed}", f"{p.column} has value range {listed}", f'.is_contained_in("{p.column}", [{listed}])')


def _sql(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


class NonNegativeNumbersRule(Rule):
    def applies(self, p, rows):
        return isinstance(p, NumericProfile) and p.minimum is not None and p.minimum >= 0

    def suggest(self, p, rows):
        return self.made(_one(Check("").is_non_negative(p.column)), p, f"Minimum: {p.minimum}", f"{p.column} has no negative values", f'.is_non_negative("{p.column}")')


class ApproximatelyUniqueRule(Rule):
    #: Relative error of the distinct count with 512 registers.
    error = 1.0389 / math.sqrt(512)

    def applies(self, p, rows):
        return rows > 0 and p.completeness == 1.0 and abs(1 - p.approx_count_distinct / rows) <= self.error

    def suggest(self, p, rows):
        return self.made(_one(Check("").is_unique(p.column)), p, f"ApproxDistinctness: {p.approx_count_distinct / rows}", f"{p.column} is unique", f'.is_unique("{p.column}")')


DEFAULT_RULES: tuple[Rule, ...] = (CompleteRule(), RetainCompletenessRule(), RetainTypeRule(), CategoricalRangeRule(), NonNegativeNumbersRule(), ApproximatelyUniqueRule())


@dataclass(frozen=True)
class ConstraintSuggestionResult:
    profiles: Profiles
    suggestions: list[ConstraintSuggestion]
    verification: DetectionResult | None
    spark: SparkSession

    def suggestion_df(self) -> DataFrame:
        return self.spark.createDataFrame([(s.column, s.description, s.code) for s in self.suggestions], "column string, description string, code string")


class SuggestionRunBuilder:
    def __init__(self, data: DataFrame) -> None:
        self.data, self.rules = data, []
        self.columns, self.threshold, self.ratio, self.seed = None, 120, None, None

    def add_constraint_rule(self, rule: Rule) -> SuggestionRunBuilder:
        self.rules.append(rule)
        return self

    def add_constraint_rules(self, rules: Iterable[Rule]) -> SuggestionRunBuilder:
        self.rules += rules
        return self

    def set_specified_columns(self, columns: list[str]) -> SuggestionRunBuilder:
        self.columns = columns
        return self

    def set_low_cardinality_threshold(self, threshold: int) -> SuggestionRunBuilder:
        self.threshold = threshold
        return self

    def set_test_set_ratio(self, ratio: float) -> SuggestionRunBuilder:
        if not 0 < ratio < 1:
            raise ValueError("the ratio must lie between 0 and 1")
        self.ratio = ratio
        return self

    def set_random_seed(self, seed: int) -> SuggestionRunBuilder:
        self.seed = seed
        return self

    def run(self) -> ConstraintSuggestionResult:
        train, test = self.data, None
        if self.ratio is not None and self.seed is not None:
            train, test = self.data.randomSplit([1 - self.ratio, self.ratio], self.seed)
        profiles = profile(train, self.columns, self.threshold)
        found = [r.suggest(p, profiles.num_records) for p in profiles.profiles.values() for r in self.rules if r.applies(p, profiles.num_records)]
        verified = DetectionSuite.on_data(test).add_check(Check("suggested", [s.constraint for s in found])).run() if test is not None and found else None
        return ConstraintSuggestionResult(profiles, found, verified, self.data.sparkSession)


class SuggestionSuite:
    @staticmethod
    def on_data(data: DataFrame) -> SuggestionRunBuilder:
        return SuggestionRunBuilder(data)
