"""The operators on the driver's tables, each with the same question in SQL.

An entry is ``name: (function, sql)``.  The function takes a session and a folder and
returns a DataFrame; the SQL names its columns alike.
"""

from cohortline.entries import feeds, orders, people, records, tables

ENTRIES = {**people.ENTRIES, **orders.ENTRIES, **records.ENTRIES, **feeds.ENTRIES, **tables.ENTRIES}
