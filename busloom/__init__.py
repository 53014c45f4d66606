"""Spark operators for bus-trip records, GPS pings, demand series and forecasts."""
