"""Expressions that lower to Columns: fields, selections, geometry."""
