"""Plans: operators composed into whole searches, dashboards and ingest runs."""
