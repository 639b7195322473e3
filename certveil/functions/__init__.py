"""Part of the redaction engine."""
