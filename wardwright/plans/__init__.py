"""Stored views, the dashboard bundle and the query catalogue."""
