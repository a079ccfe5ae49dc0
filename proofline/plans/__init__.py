"""Whole flows over the operators: retrieval, answers with citations, evaluation, gates, judging, replica runs, authoring and indexing.

Models are asked in Arrow batches; what a model replies is one row's outcome,
and so is its failure.  Each is asked once: its replies are written to the session's
checkpoint folder and read again, so a lost executor does not change them.
"""
