"""Lead files, OSM elements, fetch logs and CSV sinks."""
