"""Registered queries over the driver's tables, and independent SQL for each."""
