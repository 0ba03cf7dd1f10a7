"""Column-level building blocks: every function takes and returns Columns, so
it stays inside whole-stage code generation."""
