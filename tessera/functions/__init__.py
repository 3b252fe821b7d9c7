"""Columns from columns: no DataFrame, no action, nothing outside Catalyst."""
