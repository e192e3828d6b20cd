"""Audit reports, compliance checks and logs; all small objects on the driver."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = "report_id string, timestamp string, validation_checks map<string,boolean>, metrics map<string,double>, warnings array<string>, passed boolean"


@dataclass
class AuditReport:
    """Checks, metrics and warnings. One failed check fails the report for good."""

    report_id: str
    timestamp: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    validation_checks: dict[str, bool] = field(default_factory=dict)
    metrics: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    passed: bool = True

    def add_validation(self, name: str, ok: bool) -> None:
        self.validation_checks[name] = ok
        self.passed = self.passed and ok

    def add_metric(self, name: str, value: float) -> None:
        self.metrics[name] = float(value)

    log_metric = add_metric

    def add_warning(self, text: str) -> None:
        self.warnings.append(text)

    @property
    def summary(self) -> dict[str, str]:
        return {"report_id": self.report_id, "timestamp": self.timestamp, "passed": str(self.passed).lower(), "checks": str(len(self.validation_checks)), "warnings": str(len(self.warnings))}

    def finalize(self) -> dict[str, str]:
        return self.summary

    def to_json(self) -> str:
        return json.dumps(self.__dict__, indent=4)

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(self.__dict__.values())], REPORT)


def distribution_similarity(train: Column, test: Column, value: Column, threshold: float, literal: bool = False) -> list[Column]:
    """mean_shift, std_shift and similar as aggregates over rows that are in train or test (boolean columns). Shifts are relative to the training side; literal leaves the sign of its mean."""
    of = lambda side, f: f(F.when(side, value))
    mean, std = of(train, F.avg), of(train, F.stddev_pop)
    base = mean if literal else F.abs(mean)
    shift = F.try_divide(F.abs(of(test, F.avg) - mean), base)
    spread = F.try_divide(F.abs(of(test, F.stddev_pop) - std), std)
    return [shift.alias("mean_shift"), spread.alias("std_shift"), F.coalesce((shift < threshold) & (spread < threshold), F.lit(False)).alias("similar")]


def date_order(df: DataFrame, train: Column, test: Column, date: Column) -> DataFrame:
    """One row: the last training and first test date as text, and whether they are in order."""
    found = df.agg(F.max(F.when(train, date)).alias("train_last"), F.min(F.when(test, date)).alias("test_first"))
    return found.select("*", F.coalesce(F.col("test_first") > F.col("train_last"), F.lit(False)).alias("ordered"))


class ComplianceChecker:
    def __init__(self):
        self.rules = {
            "temporal_integrity": "training data lies before test data",
            "no_leakage": "no feature sees past the training cutoff",
            "distribution_stability": "train and test distributions are alike",
            "audit_trail": "every check is recorded",
        }

    def add_rule(self, name: str, description: str) -> None:
        self.rules[name] = description

    def check_temporal_leakage(self, train_dates: Sequence[str], test_dates: Sequence[str]) -> bool:
        """Whether all test dates follow all training dates, as text."""
        if not train_dates or not test_dates:
            raise ValueError("dates are empty")
        return min(test_dates) > max(train_dates)

    def check_distribution_similarity(self, train: Sequence[float], test: Sequence[float], threshold: float) -> bool:
        import numpy as np

        if not len(train) or not len(test):
            raise ValueError("values are empty")
        a, b = np.asarray(train, float), np.asarray(test, float)
        scale = lambda x: abs(x) or float("nan")
        return bool(abs(b.mean() - a.mean()) / scale(a.mean()) < threshold and abs(b.std() - a.std()) / scale(a.std()) < threshold)

    def run_compliance_check(self, data: dict[str, Sequence[str]]) -> AuditReport:
        report = AuditReport(f"audit_{int(time.time())}")
        ok = self.check_temporal_leakage(data["train_dates"], data["test_dates"])
        report.add_validation("temporal_integrity", ok)
        if not ok:
            report.add_warning("test data does not follow training data")
        report.add_metric("compliance_score", 100.0 if ok else 0.0)
        return report

    def __repr__(self) -> str:
        return f"ComplianceChecker(rules={len(self.rules)})"


class AuditLogger:
    def __init__(self, log_file: str = "audit.log"):
        self.log_file, self._lines = log_file, []

    def log(self, event: str, level: str | None = None) -> None:
        self._lines.append(f"[{datetime.now(UTC).isoformat(timespec='seconds')}] {level or 'INFO'} - {event}")

    def get_logs(self) -> list[str]:
        return list(self._lines)

    def save(self) -> None:
        Path(self.log_file).write_text("\n".join(self._lines))

    def __repr__(self) -> str:
        return f"AuditLogger(log_file='{self.log_file}', entries={len(self._lines)})"


class ReportGenerator:
    def __init__(self, template: str = "default"):
        self.template = template

    def generate_html(self, report: AuditReport) -> str:
        rows = lambda d: "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(str(v))}</td></tr>" for k, v in d.items())
        notes = "".join(f"<li>{html.escape(w)}</li>" for w in report.warnings)
        return (
            f"<html><head><title>{html.escape(report.report_id)}</title></head><body class='{html.escape(self.template)}'>"
            f"<h1>{html.escape(report.report_id)}</h1><p>{html.escape(report.timestamp)}: {'PASSED' if report.passed else 'FAILED'}</p>"
            f"<h2>Checks</h2><table>{rows(report.validation_checks)}</table><h2>Metrics</h2><table>{rows(report.metrics)}</table><h2>Warnings</h2><ul>{notes}</ul></body></html>"
        )

    def generate_pdf(self, report: AuditReport, path: str) -> None:
        raise NotImplementedError("PDF reports are not supported")

    def __repr__(self) -> str:
        return f"ReportGenerator(template='{self.template}')"
