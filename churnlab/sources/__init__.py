from churnlab.sources.tables import table, customer360  # noqa: F401
from churnlab.sources.files import (  # noqa: F401
    CUSTOMER_SCHEMA,
    AUDIT_SCHEMA,
    read_customers,
    read_audit,
    append_audit,
    sql_select,
    read_table,
    coalesce_sources,
)
