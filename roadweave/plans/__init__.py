"""End-to-end queries: tables and parameters in, result table out."""
