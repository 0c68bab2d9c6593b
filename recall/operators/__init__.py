"""Table and stream operators: pure functions ``DataFrame(s) -> DataFrame``."""
