"""panelflow: intensive longitudinal (panel) data operators on Spark."""
