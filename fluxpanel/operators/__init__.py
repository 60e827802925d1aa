"""DataFrame operators: panel, spatial, graph, trajectory, channels, estimation."""
