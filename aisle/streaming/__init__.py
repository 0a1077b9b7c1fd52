"""Structured Streaming form of the arrival rules and the stock ledger."""
