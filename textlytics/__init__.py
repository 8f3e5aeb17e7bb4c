"""textlytics: text-corpus analytics expressed as Spark DataFrame plans.

A corpus is any DataFrame with an id column and one or more text columns.
``operators.index.postings`` turns it into the postings table
``(doc_id, term, tf, doc_len, doc_terms)`` that nearly every other operator
reads: ranked search, term statistics, coverage reports, co-occurrence,
document similarity and Naive Bayes labelling.  Everything is lazy DataFrame
code; only sinks and jobs run actions.
"""

__version__ = "0.1.0"
