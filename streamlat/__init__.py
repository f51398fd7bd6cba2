"""Record latency, parity-windowed means and throughput of line streams, on Spark."""
