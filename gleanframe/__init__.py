"""gleanframe: distributed profiling of unfamiliar tables on Spark DataFrames.

Every analysis is a function from DataFrames to a DataFrame.  Nothing but
column metadata (names, kinds, one row of counts per column) ever reaches the
driver.
"""

from .config import Limits
from .sources.tables import Table, as_table, load_tables
from .plans.profile import Profile, profile

__all__ = ["Limits", "Profile", "Table", "as_table", "load_tables", "profile"]
