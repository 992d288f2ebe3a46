"""Writers: published snapshots and exports."""
