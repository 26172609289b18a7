"""The queries of these operators, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from .chat_format import op8_chat_format
from .decontamination import op9_decontamination
from .licenses import op7_licenses
from .line_dedup import op10_line_dedup
from .mixing import op6_mixing
from .near_dedup import op1_near_dedup
from .oracles import ORACLES
from .quality_classifier import op5_quality_classifier
from .quality_rules import op4_quality_rules
from .sharding import op3_sharding
from .url_filter import op2_url_filter

QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_url_filter, op3_sharding, op4_quality_rules, op5_quality_classifier, op6_mixing, op7_licenses, op8_chat_format, op9_decontamination, op10_line_dedup)}

__all__ = ["ORACLES", "QUERIES"]
