"""Query plans over the driver tables: derived views, registered queries
and their SQL oracles."""
