"""Where rows come from: repository trees, ingested tables, registry snapshots."""
