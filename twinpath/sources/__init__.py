"""Sources and sinks: the adapter to the driver's tables, CSV and JSON tables with fixed schemas, and elementary streams."""
