"""Sources and sinks: source trees, stored tables, driver-table corpus views."""
