"""Training and scoring of the risk ensemble on the cluster."""
