"""Progress and cancellation of running scans; the engine itself is batch."""
