"""Operators for preparing language-model training text, with their queries and SQL."""

from framemetry.llm import (  # noqa: F401
    op1_quality,
    op2_html,
    op3_warc,
    op4_simhash,
    op5_language,
    op6_lines,
    op7_units,
    op8_benchmark,
    op9_mixing,
    op10_suffix,
    op11_ranked,
    op12_recipes,
    op13_middle,
)
from framemetry.llm.registry import ORACLES, QUERIES  # noqa: F401
