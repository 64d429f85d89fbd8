"""Sources and sinks: registries, pages, bundles, versioned tables."""
