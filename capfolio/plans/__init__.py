"""The table graph and the registered queries."""
