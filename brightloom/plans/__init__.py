"""Plan-level helpers: session settings and tables that cut lineage."""
