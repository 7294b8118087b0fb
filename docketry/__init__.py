"""Spark-native document-intake analytics.

The library expresses a document-intake pipeline (notification parsing, claim
routing, object checks, extraction validation, finalization, retries, audits
and operational metrics) as DataFrame jobs and keyed streaming state.
"""

from docketry.config import IntakeConfig

__all__ = ["IntakeConfig"]
