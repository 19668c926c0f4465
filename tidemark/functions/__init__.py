"""Column expressions: severities, text measures, paths. All stay inside code generation."""
