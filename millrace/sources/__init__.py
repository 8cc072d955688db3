"""Sources and sinks: CSV text, host iteration, folders."""
