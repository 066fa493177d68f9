"""DataFrame -> DataFrame operators (profile, cleaning, transforms, chart data,
splits, metrics, models, neighbours, clustering)."""
