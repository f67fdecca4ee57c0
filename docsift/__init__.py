"""docsift: document-to-document retrieval experiments as Spark DataFrame jobs.

Sub-packages
------------
sources    scans and sinks (tables, BEIR folders, JSON triplets, index artefacts, fixtures)
functions  column-expression helpers (tokenising, stopwords, stemming, vector maths)
operators  relational operators (preparation, BM25, dense search, rerank, metrics, training sets)
plans      compositions (experiment matrix, run comparison) and the SQL oracle texts
"""

__version__ = "0.1.0"
