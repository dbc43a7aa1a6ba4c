"""Column helpers and the distributed ordering / quantile / staging primitives."""
