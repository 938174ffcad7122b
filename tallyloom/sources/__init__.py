"""Readers that stage foreign exports, documents and records, and the stored ledger."""
