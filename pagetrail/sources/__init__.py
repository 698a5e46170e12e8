"""Sources and sinks: given tables, derived history views, profile stores, snapshots."""
