"""Columns as NumPy arrays and, where torch is installed, tensors; and accelerator helpers. All work on the driver or inside a UDF."""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame

from ..operators.spec import require

#: Bytes that all reservations together may hold.
MEMORY_CAP = 16 << 30


def _torch():
    if importlib.util.find_spec("torch") is None:
        raise RuntimeError("torch is not installed")
    import torch

    return torch


class TensorBridge:
    """One column of a frame as an array or tensor; the column is collected, so pick a window of rows first."""

    def __init__(self, dtype: str | None = None):
        self.dtype = dtype

    def numpy_view(self, df: DataFrame, column: str) -> np.ndarray:
        require(df, column)
        values = df.select(column).toArrow().column(0)
        if values.null_count:
            raise ValueError(f"Column '{column}' has nulls")
        out = values.to_numpy()
        return out.astype(self.dtype, copy=False) if self.dtype else out

    def torch_tensor(self, df: DataFrame, column: str, *, device: str = "cpu"):
        torch = _torch()
        tensor = torch.from_numpy(np.array(self.numpy_view(df, column)))
        return tensor.to(device=device)


class TensorConverter:
    """Lists to arrays of one type."""

    def __init__(self, dtype: str = "float32"):
        self.dtype = dtype

    def to_tensor(self, values: Sequence[float]) -> np.ndarray:
        return np.asarray(values, self.dtype)

    def to_tensor_2d(self, rows: Sequence[Sequence[float]]) -> np.ndarray:
        out = np.asarray(rows, self.dtype)
        if out.ndim != 2:
            raise ValueError("rows differ in length")
        return out

    def reshape(self, values: np.ndarray, shape: Sequence[int]) -> np.ndarray:
        return np.reshape(values, tuple(shape))

    def __repr__(self) -> str:
        return f"TensorConverter(dtype='{self.dtype}')"


class MemoryGuard:
    """Reservations of accelerator memory in one process, under a cap."""

    held = 0

    @classmethod
    @contextmanager
    def reserve(cls, n: int, cap: int = MEMORY_CAP):
        if cls.held + n > cap:
            raise MemoryError(f"{n} bytes asked for, {cap - cls.held} free")
        cls.held += n
        try:
            yield n
        finally:
            cls.held -= n


class Accelerator:
    """Batched forward passes with a memory check; without torch the model gets NumPy arrays on the CPU."""

    def __init__(self, device: str = "cuda:0", batch_size: int = 32):
        if batch_size <= 0:
            raise ValueError("batch_size must be positive")
        self.device, self.batch_size = device, batch_size

    def is_available(self) -> bool:
        return importlib.util.find_spec("torch") is not None and _torch().cuda.is_available()

    def stats(self) -> dict[str, float | str]:
        if not self.is_available():
            return {"error": "GPU not available"}
        cuda = _torch().cuda
        return {"allocated_mb": cuda.memory_allocated() / 1e6, "reserved_mb": cuda.memory_reserved() / 1e6}

    def infer(self, forward: Callable[[np.ndarray], np.ndarray], rows: Iterable[Sequence[float]]) -> list:
        out, batch = [], []

        def flush():
            block = np.asarray(batch, np.float32)
            with MemoryGuard.reserve(block.nbytes):
                out.extend(forward(block))
            batch.clear()

        for row in rows:
            batch.append(row)
            if len(batch) == self.batch_size:
                flush()
        if batch:
            flush()
        return out

    def clear_cache(self) -> None:
        if self.is_available():
            _torch().cuda.empty_cache()

    def __repr__(self) -> str:
        return f"Accelerator(device='{self.device}', batch_size={self.batch_size})"
