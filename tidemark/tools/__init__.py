"""User-visible queries over one workspace: search, context, scan, inspect, read, export."""
