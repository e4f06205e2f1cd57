"""Column expressions for names, routes, urls, types and citations, and the filter language."""
