"""Names of the queries that have SQL, without the streaming replays (see test_streaming)."""

from tidemark.plans.catalog import ORACLES

ORACLE_NAMES = sorted(n for n in ORACLES if not n.startswith("st") or n == "st8_followup_closure")
