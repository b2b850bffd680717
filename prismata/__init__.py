"""Few-shot, multi-label, hierarchical classification analytics as Spark plans."""
