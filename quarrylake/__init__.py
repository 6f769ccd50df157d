"""quarrylake: versioned document corpora, snapshots, diffs and ranked retrieval on PySpark."""
