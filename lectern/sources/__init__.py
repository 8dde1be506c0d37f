"""Sources and sinks: files to DataFrames and back."""
