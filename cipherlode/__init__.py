"""Cryptographic inventories with PySpark: scan, label, decide, report.

Names are imported when they are first asked for, as Python workers import this package too.
"""

from importlib import import_module

_HOMES = {
    "cipherlode.operators.bom": ("summary",),
    "cipherlode.operators.labels": ("decide", "file_assets", "instructions", "label", "validate"),
    "cipherlode.operators.rulebook": ("Rulebook",),
    "cipherlode.operators.scan": ("fold_assets", "scan_text"),
    "cipherlode.plans.repository": ("Enrichment", "Run", "analyse", "batch_summary", "report", "scan_files", "write_run"),
    "cipherlode.settings": ("Settings",),
    "cipherlode.sources.github": ("GitHubRepository",),
    "cipherlode.sources.files": ("policy", "profile_names", "read_repository", "scan_profile", "select_files"),
}
_HOME = {name: home for home, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(name)
    return getattr(import_module(_HOME[name]), name)
