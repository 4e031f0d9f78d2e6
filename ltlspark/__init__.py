"""ltlspark: corpora of temporal-logic formulas and text, built, checked and measured as Spark plans."""
