"""Per-sample and per-parameter integer functions as Spark columns."""
