"""Package data: ``{language}.txt`` are the default stopword lists of Apache Spark's
StopWordsRemover (Apache License 2.0; Spark took them from the public Snowball /
stopwords corpus), one word per line, in Spark's order.
"""
