"""tidemark — sensitive-data scanning of stored pages and documents on Spark.

Named regex rules, grouped in kits, run over page bodies, response headers
and document text as Spark expressions and yield findings with offsets,
context, category and severity; around the scan sit link extraction,
reachability over the link graph, robots filtering, first-wins dedup of a
findings store, reports, sinks and a Structured Streaming form.
"""

__version__ = "0.1.0"
