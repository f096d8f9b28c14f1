"""Column-level building blocks: text, analysis, stemming and scoring."""
