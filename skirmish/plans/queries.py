"""All registered queries."""

from skirmish.plans import q_chat, q_combat, q_files, q_parse, q_stream, q_time  # noqa: F401
from skirmish.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
