from funnelkit.sources.tables import (TABLES, load, read_csv, read_dataset, split_bad,
                                      rename_at, serial_to_date, maybe_in, date_series)
from funnelkit.sources.sinks import save_cohort, load_cohort, write_csv, write_by_team, cut_lineage

__all__ = ["TABLES", "load", "read_csv", "split_bad", "read_dataset", "rename_at",
           "serial_to_date", "maybe_in", "date_series", "save_cohort", "load_cohort",
           "write_csv", "write_by_team", "cut_lineage"]
