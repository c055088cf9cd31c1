"""Sources (CSV / Parquet / JSON / XLSX readers, type inference, ingest
checks) and sinks (CSV / Parquet / JSON report writers)."""
