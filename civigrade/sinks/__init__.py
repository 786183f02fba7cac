"""Reports and exports."""
