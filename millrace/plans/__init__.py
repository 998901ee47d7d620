"""Multi-step plans over several tables, and the registered queries."""
