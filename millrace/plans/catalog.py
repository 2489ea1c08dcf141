"""The registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

from millrace.plans import contracts, corpus, evidence, feeds, ledgers, logs, overlaps, talk, texts, workflow  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "a6_source_summary"
