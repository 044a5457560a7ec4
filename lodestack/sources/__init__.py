"""Sources and sinks: library files, web pages, catalogue transfer."""
