"""Model and tool back ends that run inside Arrow batches."""
