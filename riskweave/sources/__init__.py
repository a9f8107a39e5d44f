"""Sources and sinks: readers, column mapping, fixtures, exports."""
