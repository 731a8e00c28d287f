"""slicewise: chunking-strategy evaluation for retrieval-augmented answering, on Spark.

Every operator is a DataFrame -> DataFrame function. Settings (file types,
strategies, experiments) are rows, so one set of Spark jobs evaluates a whole
batch of experiments over a whole corpus.
"""

from slicewise.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
