"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, works on whole texts, and never gathers corpus-sized data
on the driver.
"""
