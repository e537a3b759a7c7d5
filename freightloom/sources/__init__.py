from freightloom.sources.canonical import (  # noqa: F401
    FEATURE_COLUMNS,
    GRAPH_COLUMNS,
    ORDER_ITEMS_SQL,
    TOTAL_ORDER,
    known_lines,
    order_items,
    order_lines,
    table,
)
