"""All queries of this subpackage, with the SQL of those that SQL can express."""

import importlib

MODULES = ("op01_bpe", "op02_lm", "op03_quality", "op04_mixing", "op05_jaccard", "op06_lines", "op07_embedding", "op08_warc", "op09_audio", "op10_token_file")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"seine.llm.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
