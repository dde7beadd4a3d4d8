"""DataFrame operators: the cleaning catalog, profile, quality, KPIs, privacy."""
