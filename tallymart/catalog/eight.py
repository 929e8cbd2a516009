"""Reports, charts and rules over the eight normalised tables, under the SQL of the star."""

from __future__ import annotations

from tallymart.catalog import advice, charts, reports

_PICKED = {
    reports: ("q02_category_revenue", "q15_spend_rank_in_segment", "q19_order_value_changes", "q26_", "q32_", "q36_"),
    charts: ("kpi1_headline", "ch2_category_performance", "ch10_box_plot"),
    advice: ("rc6_recommendations",),
}

ENTRIES = {
    f"eight_{name}": (lambda m, build=build: build(m.normalised()), sql)
    for module, picked in _PICKED.items() for name, (build, sql) in module.ENTRIES.items()
    if name.startswith(picked) and not name.endswith("_filtered")}
