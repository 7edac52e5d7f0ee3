"""From a declarative request to a lazy DataFrame: charts, dashboards, profiles, ingestion."""
