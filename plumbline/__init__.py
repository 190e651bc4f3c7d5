"""plumbline: audit analytics over tables of text, responses, relations and event streams.

Everything is a function from DataFrames to DataFrames (or Columns to Columns).
Catalyst plans the work; nothing here schedules, parses queries or keeps data on
the driver.
"""
