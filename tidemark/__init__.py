"""Timeline evidence analytics on PySpark.

Media timelines, transcripts, on-screen text, visual descriptions and session
logs are DataFrames of half-open ``[start_ms, end_ms)`` rows keyed by
``video_id``.  Every operator is a function ``DataFrame -> DataFrame``.
"""

__version__ = "0.1.0"
