"""The registered queries, a module for each area, with their SQL."""
