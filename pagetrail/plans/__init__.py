"""End-to-end plans: registered queries, oracle SQL, ingest pipelines."""
