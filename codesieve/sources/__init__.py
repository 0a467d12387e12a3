"""Readers and writers for scan inputs, rules, configuration and the audit log."""
