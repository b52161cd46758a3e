"""Job configuration: file format, column mapping, validation rules, output."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any

# Names a saved configuration uses.
FILE_TYPES = ("delimited", "fixed", "multiline")
TOTAL_PRICE = "Total Price"
UNIT_PRICE = "Unit Price"
RULE_NAMES = ("store_validation", "item_validation", "compare_store_list", "file_review")
DEFAULT_RECORD_TYPES = ("H", "D")

# Key and measure columns of each level.
LEVELS = {
    "store": (["STORE_NUMBER"], ["Units", "Totalprice"]),
    "item": (["UPC_CODE", "PRODUCT_DESCRIPTION"], ["UNITS_SOLD", "TOTAL_DOLLARS"]),
    "upc": (["UPC"], ["UNITS_SOLD", "TOTAL_DOLLARS"]),
}


@dataclass(frozen=True)
class LayoutField:
    """One positional field; ``start`` is 0-based, ``end`` exclusive."""

    field: str
    start: int
    end: int
    type: str = "text"

    @property
    def length(self) -> int:
        return self.end - self.start


def as_layout(spec) -> list[LayoutField]:
    """Accept ``LayoutField`` objects, mappings or (field, start, end[, type]) tuples."""
    out = []
    for f in spec or []:
        if isinstance(f, LayoutField):
            out.append(f)
        elif isinstance(f, dict):
            out.append(LayoutField(f["field"], int(f["start"]), int(f["end"]), f.get("type", "text")))
        else:
            out.append(LayoutField(*f))
    return out


@dataclass
class ValidationRule:
    """One check. Empty column lists mean the defaults of its level."""

    enabled: bool = True
    required_columns: list[str] = field(default_factory=list)
    group_by_columns: list[str] = field(default_factory=list)
    aggregation_columns: list[str] = field(default_factory=list)


def _level_rule(level: str) -> ValidationRule:
    keys, sums = LEVELS[level]
    return ValidationRule(required_columns=[*keys, *sums], group_by_columns=list(keys), aggregation_columns=list(sums))


def _store_list_rule() -> ValidationRule:
    keys, _ = LEVELS["store"]
    return ValidationRule(required_columns=list(keys), group_by_columns=list(keys))


def _review_rule() -> ValidationRule:
    """Stores and UPCs are counted, item measures summed; the review has groups of its own."""
    return ValidationRule(required_columns=[*LEVELS["store"][0], LEVELS["item"][0][0], *LEVELS["item"][1]])


@dataclass
class ValidationConfig:
    store_validation: ValidationRule = field(default_factory=lambda: _level_rule("store"))
    item_validation: ValidationRule = field(default_factory=lambda: _level_rule("item"))
    compare_store_list: ValidationRule = field(default_factory=_store_list_rule)
    file_review: ValidationRule = field(default_factory=_review_rule)


@dataclass
class OutputConfig:
    # Names and defaults of a saved configuration. Only ``format`` changes what is written.
    format: str = "csv"
    include_file_review: bool = True
    include_validation_details: bool = True
    download_results: bool = True


@dataclass
class FormatConfig:
    """How to read one side's files and which columns play which role.

    The ``*_layout`` lists are the loaded form of the ``*_layout_file`` paths
    (see :func:`posrecon.sources.layout.resolve_layouts`); they are not saved.
    """

    # Names and defaults of a saved configuration.
    version: int = 2
    name: str = ""
    file_type: str | None = None
    encoding: str = "cp1252"
    has_header: bool = True
    delimiter: str | None = None
    start_line: int = 0
    mixed_headers: bool = False
    pad_ragged: bool = False
    quoted_newlines: bool = False
    record_type: str | None = None
    layout_file: str | None = None
    header_prefix: str | None = None
    header_layout_file: str | None = None
    detail_layout_file: str | None = None
    trailer_prefix: str | None = None
    trailer_layout_file: str | None = None
    ml_record_types: list[str] | None = None
    ml_delimiter: str = "|"
    schema: list[str] | None = None
    detected_columns: list[str] | None = None
    detected_data_types: dict[str, str] | None = None
    suggested_mapping: dict[str, str] | None = None
    store_col: str | None = None
    upc_col: str | None = None
    desc_col: str | None = None
    units_col: str | None = None
    price_col: str | None = None
    price_type: str = TOTAL_PRICE
    implied_dollars: bool = False
    implied_units: bool = False
    validation_config: ValidationConfig = field(default_factory=ValidationConfig)
    output_config: OutputConfig = field(default_factory=OutputConfig)
    locked: bool = False
    layout: list[LayoutField] | None = None
    header_layout: list[LayoutField] | None = None
    detail_layout: list[LayoutField] | None = None
    trailer_layout: list[LayoutField] | None = None

    def with_(self, **changes: Any) -> "FormatConfig":
        return replace(self, **changes)

    def require(self, *roles: str) -> None:
        """Raise when a role column needed by a level is not mapped."""
        missing = [r for r in roles if not getattr(self, r)]
        if missing:
            raise ValueError(f"column mapping is missing: {', '.join(missing)}")


_NOT_SAVED = ("layout", "header_layout", "detail_layout", "trailer_layout")


def config_from_dict(data: dict[str, Any]) -> FormatConfig:
    known = {f.name for f in fields(FormatConfig)} - set(_NOT_SAVED)
    plain = {
        k: v
        for k, v in data.items()
        if k in known and k not in ("validation_config", "output_config")
    }
    cfg = FormatConfig(**plain)
    for name, rule in (data.get("validation_config") or {}).items():
        if name in RULE_NAMES and rule:
            setattr(cfg.validation_config, name, ValidationRule(**rule))
    if data.get("output_config"):
        cfg.output_config = OutputConfig(**data["output_config"])
    return cfg


def load_format_config(path: str, spark=None) -> FormatConfig:
    """Load a saved configuration; a session reads it from any store that Spark reads."""
    if spark is not None:
        return config_from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    with open(path, encoding="utf-8") as f:
        return config_from_dict(json.load(f))


def save_format_config(config: FormatConfig, path: str, spark=None) -> None:
    """Save a configuration; a session writes it to any store that Spark writes to."""
    data = {k: v for k, v in asdict(config).items() if k not in _NOT_SAVED}
    write_text(json.dumps(data, indent=2), path, spark)


def write_text(text: str, path: str, spark=None) -> None:
    """One small file; with a session through the file system of its path."""
    if spark is None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
        return
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def resolve_path(path: str | None, base_dir: str | None) -> str | None:
    """Layout paths in a configuration are relative to the configuration's folder."""
    if not path:
        return None
    if os.path.isabs(path) or "://" in path:
        return path
    if base_dir and "://" in base_dir:
        return base_dir.rstrip("/") + "/" + path
    return os.path.normpath(os.path.join(base_dir or ".", path))
