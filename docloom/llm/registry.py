"""The queries of this subpackage and, where SQL can express them, the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.chat import OP4_SQL, op4_perspective_rotation
from docloom.llm.decontaminate import OP1_SQL, op1_decontaminate
from docloom.llm.language import op6_language_id
from docloom.llm.linededup import op9_line_dedup
from docloom.llm.neardup import op7_near_dedup
from docloom.llm.packing import op8_packing
from docloom.llm.quality import OP2_SQL, op2_quality_rules
from docloom.llm.sharding import op5_sharding
from docloom.llm.suffixes import op10_suffix_dedup
from docloom.llm.urls import op3_url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_decontaminate, op2_quality_rules, op3_url_filter, op4_perspective_rotation, op5_sharding, op6_language_id,
        op7_near_dedup, op8_packing, op9_line_dedup, op10_suffix_dedup,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        op1_decontaminate.__name__: OP1_SQL,
        op2_quality_rules.__name__: OP2_SQL,
        op4_perspective_rotation.__name__: OP4_SQL,
    }
