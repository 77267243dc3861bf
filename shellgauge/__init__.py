"""Risk analytics over agent commands, transcripts, answers and decision logs on Spark."""
