"""Reading and writing: corpora, items, tasks, scores and metrics."""
