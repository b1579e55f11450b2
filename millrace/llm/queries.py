"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .exact_dedup import OP9_SQL, op9_exact_dedup
from .language_id import op1_language_id
from .mixing import OP10_SQL, op10_mixing
from .near_dedup import op7_near_dedup
from .packing import op3_packing
from .pii import op2_pii
from .quality import op6_quality
from .secrets import op8_secrets
from .topk import OP5_SQL, op5_topk
from .toxicity import op4_toxicity


def queries() -> dict:
    return {
        "op1_language_id": op1_language_id,
        "op2_pii": op2_pii,
        "op3_packing": op3_packing,
        "op4_toxicity": op4_toxicity,
        "op5_topk": op5_topk,
        "op6_quality": op6_quality,
        "op7_near_dedup": op7_near_dedup,
        "op8_secrets": op8_secrets,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op9_exact_dedup": OP9_SQL, "op10_mixing": OP10_SQL}
