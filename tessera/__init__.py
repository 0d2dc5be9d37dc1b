"""tessera: puzzle-corpus building and prediction scoring as Spark DataFrame jobs.

Layout
  functions/  Column builders (seeded hash, grid algebra, text, scoring)
  operators/  DataFrame -> DataFrame operators (sampling, ids, augmentation,
              votes, metrics, batching, strata, vocabularies, embeddings ...)
  sources/    readers for the corpus sources and the sinks that write results
  streaming/  Structured Streaming versions of the incremental operators
  plans/      fixture adapters over the driver tables and the registered queries
"""

from tessera.session import get_session, ensure_checkpoint_dir  # noqa: F401

__all__ = ["get_session", "ensure_checkpoint_dir"]
