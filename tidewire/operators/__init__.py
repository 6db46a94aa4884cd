"""DataFrame -> DataFrame operators (filters, duplicates, tone, summaries...)."""
