"""muniprop: municipal building-portfolio analytics on Spark.

Three layers, all native DataFrame expressions:

* ``functions``  - scalar Column helpers and the fixed code tables;
* ``operators``  - ownership filter, enrichment, sub-unit merge, report operators;
* ``plans``      - compositions: the enrichment pipeline, report packages, bounded SQL;
* ``sources``    - manifests, scans, the ``properties`` table, fingerprints, export;
* ``streaming``  - incremental ingest of newly arriving source files.

Every report is computed for all municipalities in one pass, keyed by ``kommune_key``.
"""

__all__ = ["session"]
