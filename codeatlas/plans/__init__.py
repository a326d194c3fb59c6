"""Composite plans (build, briefing) and the query catalog."""
