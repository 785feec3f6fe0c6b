"""Lodestone: DataFrame operators for judging how original software projects are.

Layout
------
``sources``    readers and writers for corpora, payloads and result tables
``functions``  column expressions (keys, numeric, text, paths, payloads)
``operators``  DataFrame -> DataFrame operators (joins, roll-ups, manifests, usage,
               graph, scoring, tuning)
``streaming``  incremental and resumable jobs
``plans``      views over the test tables and the catalogue of checked queries
"""
