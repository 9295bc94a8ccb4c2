"""DataFrame operators. Rows are keyed by ``repo_id`` and ``relative_path``."""
