"""Lakewarden: a PySpark-native engine for preparing, screening, searching and auditing document corpora.

Every operator is a function from DataFrames to a DataFrame; the subpackages are

* ``functions``  - column expressions (text, sets, numbers, maths),
* ``operators``  - relational operators over whole tables,
* ``sources``    - readers and writers,
* ``plans``      - composed pipelines and the registered queries,
* ``streaming``  - Structured Streaming twins of the stateful operators,
* ``llm``        - training-data operators; nothing else imports them.
"""

__version__ = "0.1.0"
