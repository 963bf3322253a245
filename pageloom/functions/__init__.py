"""Column-level functions: titles, wikitext, dates, ISBN, entities, time zones."""
