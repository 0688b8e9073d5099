"""stockflow: multi-channel stock accounting as Spark DataFrame operators.

Sub-packages
------------
functions   Column-level expressions (normalisers, notes, payloads, HMAC).
sources     Readers for inventory files, order documents, signed payloads and
            the driver test tables.
operators   Set-at-a-time operators: resolution, dedupe, ordered scans, ledger,
            outbox, reconcile, reports.
plans       End-to-end batch plans built from the operators (import, ingest,
            dispatch, reconcile).
streaming   Structured Streaming wrappers (foreachBatch) around the plans.
"""

__version__ = "0.1.0"
