"""Operators over ledgers, statement lines and page geometry."""
