"""Reading and writing tables, findings and manifests."""
