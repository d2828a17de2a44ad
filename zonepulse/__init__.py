"""PySpark analytics over zones, flows, cases, reports, indicators and text."""
