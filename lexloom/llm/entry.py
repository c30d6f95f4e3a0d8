"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ("p1_scan", "p2_sentences", "p3_splits", "p4_near", "p5_language", "p6_encoding", "p7_alignment", "p8_tokens", "p9_leaks", "p10_quality")


def queries() -> dict:
    """Every function of the modules whose name starts with p and the module's number."""
    found = {}
    for name in MODULES:
        try:
            module = import_module(f"{__package__}.{name}")
        except ModuleNotFoundError as e:
            if e.name != f"{__package__}.{name}":
                raise
            continue
        prefix = name.split("_")[0] + "_"
        found |= {k: f for k, f in vars(module).items() if k.startswith(prefix) and callable(f)}
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        try:
            module = import_module(f"{__package__}.{name}")
        except ModuleNotFoundError:
            continue
        found |= getattr(module, "SQL", {})
    return found
