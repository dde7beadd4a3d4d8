"""Cleaning plans: steps, rule tables, proposal, execution with audit, replay."""
