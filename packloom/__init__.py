"""packloom: a PySpark engine for evidence packs, causal graphs and answer audits."""
