"""End-to-end work: wave ingest, panels, state tables, group series."""
