"""Query registrations: one per operator of the inventory."""

from __future__ import annotations

from copyhound.plans import passages as PS
from copyhound.plans.catalog import register

register("x1_gram_similarity", PS.pairs_sql())(lambda s, d: PS.passage_pairs(s, d))
register("copied_passages", PS.copied_sql())(lambda s, d: PS.copied_passages(s, d))
register("p3_file_report", PS.file_report_sql())(lambda s, d: PS.passage_file_report(s, d))
register("p4_overall_report", PS.overall_sql())(lambda s, d: PS.passage_overall_report(s, d))
from copyhound.plans import admission  # noqa: E402,F401
from copyhound.plans import normalization  # noqa: E402,F401
from copyhound.plans import blocks_q  # noqa: E402,F401
from copyhound.plans import code_check_q  # noqa: E402,F401
from copyhound.plans import web_q  # noqa: E402,F401
from copyhound.plans import stream_q  # noqa: E402,F401
from copyhound.plans import more_q  # noqa: E402,F401
from copyhound.plans import alias_q  # noqa: E402,F401
from copyhound.plans import full_check  # noqa: E402,F401
from copyhound.plans import index_q  # noqa: E402,F401
