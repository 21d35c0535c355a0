"""Named queries over the test tables, each with the SQL that checks it."""

from sluicebox.queries import export, messages, profile, split, stream
from sluicebox.queries.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "export", "messages", "profile", "split", "stream"]
