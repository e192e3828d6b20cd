"""Named chains of validation steps, a registry for them, and job descriptors."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame

from ..operators.leakage import LeakageDetector
from ..operators.splits import Moment, temporal_split, validate_coverage
from .audit import AuditReport

Step = Callable[[DataFrame, dict], DataFrame]


class ValidationPipeline:
    """Ordered temporal splits of one frame. Each applies to the original frame; the last one's sides are the artifacts."""

    def __init__(self, pipeline_id: str):
        self.pipeline_id, self.steps = pipeline_id, []

    def add_temporal_split(self, time_col: str, train_end: Moment, test_start: Moment | None = None) -> ValidationPipeline:
        self.steps.append((time_col, train_end, test_start))
        return self

    def run(self, df: DataFrame) -> dict:
        """artifacts: lazy frames input, train and test; audit: a report."""
        artifacts, report = {"input": df}, AuditReport(self.pipeline_id)
        for k, (time_col, train_end, test_start) in enumerate(self.steps):
            if test_start is not None:
                validate_coverage(df, time_col, train_end, test_start)
            artifacts["train"], artifacts["test"] = temporal_split(df, time_col, train_end, test_start)
            report.add_validation(f"temporal_split_{k}", True)
        return {"artifacts": artifacts, "audit": report}


class ManagedPipeline:
    """Steps `type:name` with a configuration. Known types: temporal_split (needs time_col and temporal_cutoff), leakage_check (time_col, value_col and a detector) and feature_validation (required_columns); register() adds others."""

    types: dict[str, Step] = {}

    def __init__(self, pipeline_id: str):
        self.pipeline_id, self.steps, self.config = pipeline_id, [], {}

    @classmethod
    def register(cls, name: str, step: Step) -> None:
        cls.types[name] = step

    def add_step(self, name: str, step_type: str = "temporal_split") -> ManagedPipeline:
        self.steps.append((step_type, name))
        return self

    add_validation_step = add_step

    def set_config(self, key: str, value) -> ManagedPipeline:
        self.config[key] = value
        return self

    def execute(self, df: DataFrame) -> DataFrame:
        for step_type, _ in self.steps:
            if step_type not in self.types:
                raise ValueError(f"Unknown step type: {step_type}")
            df = self.types[step_type](df, self.config)
        return df

    run = execute

    def get_status(self) -> dict[str, str]:
        return {"pipeline_id": self.pipeline_id, "steps": str(len(self.steps)), "status": "ready"}

    def __repr__(self) -> str:
        return f"ManagedPipeline(id='{self.pipeline_id}', steps={len(self.steps)})"


def _split(df: DataFrame, config: dict) -> DataFrame:
    if "temporal_cutoff" not in config:
        raise ValueError("temporal_cutoff not configured")
    return temporal_split(df, config["time_col"], config["temporal_cutoff"])[0]


def _leakage(df: DataFrame, config: dict) -> DataFrame:
    detector: LeakageDetector = config["detector"]
    detector.check_test_frame(df, config["time_col"], config["value_col"], config.get("name", "data"))
    return df


def _features(df: DataFrame, config: dict) -> DataFrame:
    if missing := [c for c in config.get("required_columns", ()) if c not in df.columns]:
        raise ValueError(f"Columns not found: {missing}")
    return df


ManagedPipeline.types |= {"temporal_split": _split, "leakage_check": _leakage, "feature_validation": _features}


class PipelineRegistry:
    def __init__(self):
        self._known: dict[str, str] = {}

    def register(self, pipeline_id: str, config_json: str) -> None:
        self._known[pipeline_id] = config_json

    def get(self, pipeline_id: str) -> str | None:
        return self._known.get(pipeline_id)

    def list_pipelines(self) -> list[str]:
        return sorted(self._known)

    def delete(self, pipeline_id: str) -> bool:
        return self._known.pop(pipeline_id, None) is not None


class ValidationScheduler:
    """A cron line for a pipeline; nothing is started."""

    cron = {"hourly": "0 * * * *", "daily": "0 0 * * *", "weekly": "0 0 * * 0"}

    def __init__(self, pipeline_id: str, schedule: str = "daily"):
        self.pipeline_id, self.schedule = pipeline_id, schedule

    def schedule_run(self, cron_expression: str | None = None) -> str:
        line = cron_expression or self.cron.get(self.schedule, self.cron["daily"])
        return f"Pipeline '{self.pipeline_id}' scheduled: {line}"

    def __repr__(self) -> str:
        return f"ValidationScheduler(pipeline_id='{self.pipeline_id}', schedule='{self.schedule}')"


@dataclass
class JobConfig:
    function: str = "backtest"
    timeout: int = 300
    memory_mb: int = 3008


@dataclass
class BacktestJob:
    """A description of a backtest to run elsewhere. It can be sent by a function that is given, or written as arguments of spark-submit."""

    dataset_uri: str
    target_col: str
    time_col: str
    config: JobConfig = field(default_factory=JobConfig)

    def payload(self, with_config: bool = False) -> dict:
        body = {"dataset_uri": self.dataset_uri, "target_col": self.target_col, "time_col": self.time_col, "format": "arrow_or_parquet", "zero_copy_required": True}
        return body | ({"config": asdict(self.config)} if with_config else {})

    def submit(self, send: Callable[[str, bytes], str] | None = None) -> str:
        if send is None:
            raise RuntimeError("no client to submit the job with")
        return send(self.config.function, json.dumps(self.payload()).encode())

    def spark_submit_args(self, script: str) -> list[str]:
        return ["spark-submit", "--driver-memory", f"{self.config.memory_mb}m", script, json.dumps(self.payload())]
