"""Ledger controls and carbon accounting as Spark DataFrame operators."""
