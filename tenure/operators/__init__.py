"""Report operators, table changes, quality checks and telemetry rollups."""
