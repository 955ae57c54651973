"""All oracle statements, keyed like the registered queries."""

from gridweave.plans.oracle import MAPPING_SQL
from gridweave.plans.oracle_deep import DEEP_SQL
from gridweave.plans.oracle_shape import SHAPE_SQL
from gridweave.plans.oracle_web import WEB_SQL

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL.update(MAPPING_SQL)
ORACLE_SQL.update(WEB_SQL)
ORACLE_SQL.update(SHAPE_SQL)
ORACLE_SQL.update(DEEP_SQL)
