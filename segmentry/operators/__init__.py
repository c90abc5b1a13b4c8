"""Jobs over trajectories, pairs, labels, metrics, particles and frames."""
