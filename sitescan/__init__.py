"""sitescan: genomic site analysis as Spark DataFrames."""

from sitescan import defaults, functions, operators, plans, sources
from sitescan.session import build_session, scratch, shared_dir

__all__ = ["build_session", "defaults", "functions", "operators", "plans", "scratch", "shared_dir", "sources"]
