"""funnelkit: lead-lifecycle analytics (funnels, cohorts, attribution, as-of
lookups, rollups and pacing) expressed with the PySpark DataFrame and SQL APIs.

Every public function takes and returns lazy DataFrames or Columns; nothing is
collected to the driver. Run dates and value lists are explicit parameters.
"""

from funnelkit.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
