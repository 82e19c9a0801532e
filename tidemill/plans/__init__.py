"""Registered queries over the test tables, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from tidemill.plans import events, flows, more, records, text

QUERIES = text.QUERIES | records.QUERIES | events.QUERIES | more.QUERIES | flows.QUERIES
ORACLES = text.ORACLES | records.ORACLES | events.ORACLES | more.ORACLES | flows.ORACLES
