"""Entity inventories over text corpora, as Spark DataFrame plans.

Layout:

* ``functions``  -- Column expressions: whitespace, HTML, Persian text, features, spans, digests
* ``operators``  -- DataFrame -> DataFrame steps: corpus contract, annotators, mentions, rules, reports, verification
* ``sources``    -- readers and writers for corpora, inventories, reports and checksum lists
* ``plans``      -- whole jobs put together from the operators
* ``streaming``  -- the same jobs over file streams
"""
