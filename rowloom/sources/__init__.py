"""Table sources, dataset recipes, run grids, result files."""
