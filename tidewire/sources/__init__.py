"""Sources and sinks: raw drops, landed records, monthly CSVs, file health."""
