"""Writing results: text formats as lines of a table, binary ones by the task that has the rows."""
