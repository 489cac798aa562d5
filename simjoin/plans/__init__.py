"""Configurations, the join entry point and composite jobs."""
