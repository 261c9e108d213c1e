"""Sources and sinks: delimited-text series files, Parquet / JSON / CSV stores."""
