"""DataFrame operators: cleaning pipelines, entity resolution, gates, contracts."""
