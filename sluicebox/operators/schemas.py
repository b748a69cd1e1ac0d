"""Schemas of a record's validation."""

from __future__ import annotations

from sluicebox.operators.tools import OLD_RUN, TOOL_RUN

BALANCE = "STRUCT<window_size: INT, stride: INT, vulnerable_token_count: INT, fixed_token_count: INT, positive_window_count: INT, negative_window_count: INT, badpart_token_count: INT, badpart_token_ratio: DOUBLE, fixed_token_retention: DOUBLE>"
VALIDATION = f"""STRUCT<passed: BOOLEAN, reasons: ARRAY<STRING>, warnings: ARRAY<STRING>,
structural: STRUCT<passed: BOOLEAN, reasons: ARRAY<STRING>, vulnerable_markers: ARRAY<STRING>, fixed_markers: ARRAY<STRING>>,
bandit_before: {TOOL_RUN}, bandit_after: {TOOL_RUN}, semgrep_before: {TOOL_RUN}, semgrep_after: {TOOL_RUN},
tool_results: STRUCT<bandit: {OLD_RUN}, semgrep: {OLD_RUN}>, window_balance: {BALANCE}>"""
