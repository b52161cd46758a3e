"""Report output."""

from __future__ import annotations

from pyspark.sql import DataFrame

from posrecon.config import OutputConfig


def write_report(
    df: DataFrame, path: str, output: OutputConfig | str = "csv", mode: str = "overwrite"
) -> None:
    """Write one report folder as CSV with a header, or as Parquet."""
    fmt = output if isinstance(output, str) else output.format
    if fmt == "csv":
        df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    else:
        raise ValueError(f"Unsupported output format: {fmt}")


def write_reports(
    frames: dict[str, DataFrame], base_path: str, output: OutputConfig | str = "csv"
) -> dict[str, str]:
    """One sub-folder per report; returns the folders written."""
    written = {}
    for name, df in frames.items():
        target = f"{base_path.rstrip('/')}/{name}"
        write_report(df, target, output)
        written[name] = target
    return written
