from changeflow.sources.tables import append_once, read_table, stream_table, upsert_state, write_table

__all__ = ["append_once", "read_table", "stream_table", "upsert_state", "write_table"]
