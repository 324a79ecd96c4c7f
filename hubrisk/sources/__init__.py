"""Sources: schemas, file ingest, and proxy views over the driver tables."""
