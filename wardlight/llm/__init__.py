"""Training-data operators: scans, filters, formatting, de-duplication, language and quality models.

Nothing outside this package imports it.  Each module holds one operator with its general interface;
:mod:`wardlight.llm.registry` holds the thin queries over the standard tables and their SQL.
"""
