"""Column functions: text, addresses, scores, vectors, time. Each takes and returns Columns and stays inside codegen."""
