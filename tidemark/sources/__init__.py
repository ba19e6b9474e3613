"""Sources and sinks: diff text, test results, run ledgers, fragment tables."""
