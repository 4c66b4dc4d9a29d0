"""waitline: point-in-time response-latency analytics on Spark DataFrames."""

from waitline.conf import RULES, Rule, Settings
from waitline.session import get_session, shared_dir

__all__ = ["RULES", "Rule", "Settings", "get_session", "shared_dir"]
