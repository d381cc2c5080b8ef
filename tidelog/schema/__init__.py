"""Table schemas: statements, versions, history."""
