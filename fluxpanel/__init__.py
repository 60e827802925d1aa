"""Spatial panel analytics on Spark: gridded fields to panels, directed graphs,
spatial lags, instrumental-variable estimates and multipliers."""
