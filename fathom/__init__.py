"""fathom: a DataFrame-first analytics engine for operational diagnostics."""
