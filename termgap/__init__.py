"""termgap: search-content gap analysis as Spark DataFrame operators.

Every operator works on tables keyed by ``query_id`` (one keyword = one group), so one Spark job analyses one
keyword or millions of them.
"""

from termgap.params import Params

__all__ = ["Params"]
