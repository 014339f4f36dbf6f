"""docspark: document preparation, change tracking and retrieval as Spark jobs.

Every public operator takes and returns DataFrames. Sub-packages:

* ``sources``   -- file scans and per-format readers
* ``functions`` -- Column-expression builders (pure JVM expressions)
* ``operators`` -- cleaning, sections, chunks, changes, keyed tables,
                   embedding, retrieval, model-output parsing
* ``streaming`` -- token-delta stream parsing with keyed state
* ``plans``     -- end-to-end jobs (ingest, sync, search) plus the
                   registered queries and their SQL oracles
"""

from docspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
