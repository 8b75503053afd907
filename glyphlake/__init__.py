"""glyphlake: a Spark catalogue and audit engine for stored web-asset crawls.

Everything is a function from DataFrames to a DataFrame.  Pages, style sheets,
catalogue dumps and file metrics come in as tables; links, faces, coverage
verdicts and crawl reports come out as tables.  Nothing is fetched.
"""
