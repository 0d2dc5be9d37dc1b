"""Registered queries. Importing this package fills ``registry.QUERIES`` / ``ORACLES``."""

from tessera.plans import q_batching, q_boards, q_grid, q_ids, q_logic, q_metrics, q_sampling, q_state, q_text, q_votes  # noqa: F401
from tessera.plans import q_checks, q_corpus, q_files, q_io, q_stream  # noqa: F401,E402  (reuse oracles registered above)
from tessera.plans.registry import ORACLES, QUERIES  # noqa: F401
