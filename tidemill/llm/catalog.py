"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidemill.llm import op1_substring_dedup as op1
from tidemill.llm import op10_media as op10
from tidemill.llm import op2_license_scan as op2
from tidemill.llm import op3_secret_scan as op3
from tidemill.llm import op4_simhash as op4
from tidemill.llm import op5_decontaminate as op5
from tidemill.llm import op6_token_file as op6
from tidemill.llm import op7_language_id as op7
from tidemill.llm import op8_lm_score as op8
from tidemill.llm import op9_bpe as op9

MODULES = (op1, op2, op3, op4, op5, op6, op7, op8, op9, op10)


def queries() -> dict[str, Callable]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
