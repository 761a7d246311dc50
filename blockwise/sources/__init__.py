"""File sources and sinks (parquet/CSV/JSON/text)."""
