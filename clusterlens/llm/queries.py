"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from clusterlens.llm import exact_dedup as op10
from clusterlens.llm import language_id as op5
from clusterlens.llm import line_dedup as op3
from clusterlens.llm import merkle as op12
from clusterlens.llm import near_dedup as op9
from clusterlens.llm import packing as op7
from clusterlens.llm import pieces as op8
from clusterlens.llm import pii as op2
from clusterlens.llm import resampling as op4
from clusterlens.llm import secret_scan as op6
from clusterlens.llm import sharding as op13
from clusterlens.llm import topk_search as op1
from clusterlens.llm import whitening as op11

QUERIES = {
    "op1_topk_search": op1.op1_topk_search,
    "op2_pii": op2.op2_pii,
    "op3_line_dedup": op3.op3_line_dedup,
    "op4_resampling": op4.op4_resampling,
    "op5_language_id": op5.op5_language_id,
    "op6_secret_scan": op6.op6_secret_scan,
    "op7_packing": op7.op7_packing,
    "op8_pieces": op8.op8_pieces,
    "op9_near_dedup": op9.op9_near_dedup,
    "op10_exact_dedup": op10.op10_exact_dedup,
    "op11_whitening": op11.op11_whitening,
    "op12_merkle": op12.op12_merkle,
    "op13_sharding": op13.op13_sharding,
}

SQL = {
    "op1_topk_search": op1.OP1_SQL,
    "op6_secret_scan": op6.OP6_SQL,
    "op9_near_dedup": op9.OP9_SQL,
    "op10_exact_dedup": op10.OP10_SQL,
    "op12_merkle": op12.OP12_SQL,
    "op13_sharding": op13.OP13_SQL,
}
