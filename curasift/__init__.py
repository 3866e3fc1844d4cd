"""curasift: document alerting and curation as Spark DataFrame transforms.

Layout
------
functions/   Column -> Column expressions (text cleaning, sentence split,
             highlighting, classification, fuzzy ratio, labels)
operators/   DataFrame -> DataFrame transforms (search, snippets, tagging,
             pairs, metadata filters, alert expansion and merging)
sources/     table readers and the shared-test-table views (articles, scores,
             alerts, dictionary, known pairs, messages)
plans/       user-level jobs: curation, daily statistics, digest, sinks
streaming/   the same per-document transforms on a readStream
"""

__all__ = ["session"]
