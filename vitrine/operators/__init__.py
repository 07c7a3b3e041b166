"""Reading windows and pages, filtered or sorted, and summaries of columns."""
