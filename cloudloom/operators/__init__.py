"""DataFrame operators on point clouds and residue tables."""
